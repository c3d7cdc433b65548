"""Registered queries of the econometrics operators over the sample tables, each with the SQL that gives the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .catalog import register
from .functions import vectors as vec
from .operators import diagnostics as dg
from .operators import glm, linalg, panel, realized, risk, tseries, vol
from .operators import regression as rg
from .operators import returns as rt
from .operators import simulation as sim
from .sources.tables import read_table
from .sqlgen import inverse, regression

USER, KIND, BY_TIME = ["user_id"], ["event_type"], ["ts", "event_id"]
#: One Spark partition key and order is kept through a query, so that its windows share an exchange and a sort.
SERIES = """s AS (SELECT user_id, event_id, ts, value, nullif(value, 0) AS p, row_number() OVER w - 1 AS seq, nullif(lag(value) OVER w, 0) AS p1
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r0 AS (SELECT user_id, event_id, ts, seq, value, ln(p / p1) AS r FROM s WHERE seq > 0),
r AS (SELECT *, lag(r) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r1 FROM r0)"""
DAILY = "d AS (SELECT o_orderdate::DATE AS day, sum(o_totalprice) / 1e5 AS y, count(*) / 1.0 AS c FROM orders GROUP BY 1), ds AS (SELECT *, row_number() OVER (ORDER BY day) - 1 AS seq FROM d)"
AUTO_LAG = "floor(pow(n, 1 / 3.0))"
LINES = "l AS (SELECT l_extendedprice / 1e4 AS y, l_quantity / 10 AS x, l_discount * 10 AS z, l_suppkey FROM lineitem)"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")


def _returns(spark: SparkSession, d: str) -> DataFrame:
    return rt.log_returns(_events(spark, d), "value", USER, BY_TIME)


def _daily(spark: SparkSession, d: str) -> DataFrame:
    """One series of days; a sum by day, so its length is that of the calendar, not of the data."""
    o = read_table(spark, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day"))
    return o.agg((F.sum("o_totalprice") / 1e5).alias("y"), (F.count(F.lit(1)) / 1.0).alias("c")).withColumn("one", F.lit(1))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "lineitem").select((F.col("l_extendedprice") / 1e4).alias("y"), (F.col("l_quantity") / 10).alias("x"), (F.col("l_discount") * 10).alias("z"), "l_suppkey")


def _rounded(df: DataFrame, digits: int = 6, keep: tuple = ()) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


def _r(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) AS {name}"


@register("realized_measures", f"""WITH {SERIES}, m AS (SELECT user_id, count(r) AS n, sum(r * r) AS rv, pi() / 2 * count(r) / nullif(count(r) - 1, 0) * sum(abs(r) * abs(r1)) AS bv,
  sum(CASE WHEN r IS NOT NULL THEN CASE WHEN r > 0 THEN r * r ELSE 0 END END) AS rp, sum(CASE WHEN r IS NOT NULL THEN CASE WHEN r < 0 THEN r * r ELSE 0 END END) AS rn FROM r GROUP BY 1)
SELECT user_id, n AS n_obs, {_r('rv', 'rv')}, {_r('sqrt(rv)', 'rvol')}, {_r('bv', 'bv')}, {_r('greatest(rv - bv, 0)', 'jump')}, {_r('rp', 'rsv_pos')}, {_r('rn', 'rsv_neg')} FROM m""")
def realized_measures(spark, d):
    return _rounded(realized.measures_of_prices(_events(spark, d), "value", USER, BY_TIME))


@register("log_returns", f"WITH {SERIES} SELECT user_id, event_id, seq::BIGINT AS seq, {_r('r', 'r', 9)} FROM r0")
def log_returns(spark, d):
    return _rounded(_returns(spark, d).select("user_id", "event_id", "seq", "r"), 9)


@register("simple_returns", f"WITH {SERIES} SELECT user_id, event_id, seq::BIGINT AS seq, {_r('(value - p1) / p1', 'r')} FROM s WHERE seq > 0")
def simple_returns(spark, d):
    return _rounded(rt.simple_returns(_events(spark, d), "value", USER, BY_TIME).select("user_id", "event_id", "seq", "r"))


@register("difference_2", "WITH s AS (SELECT user_id, event_id, row_number() OVER w - 1 AS seq, value - 2 * lag(value) OVER w + lag(value, 2) OVER w AS dy FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, event_id, round(dy, 4) AS dy FROM s WHERE seq >= 2")
def difference_2(spark, d):
    return _rounded(rt.difference(_events(spark, d), "value", 2, USER, BY_TIME).select("user_id", "event_id", "dy"), 4)


@register("undifference", "SELECT user_id, event_id, round(10 + sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 4) AS y FROM events")
def undifference(spark, d):
    return _rounded(rt.undifference(_events(spark, d), "value", [10.0], USER, BY_TIME).select("user_id", "event_id", "y"), 4)


@register("rolling_stats", """WITH s AS (SELECT user_id, event_id, row_number() OVER o - 1 AS seq, avg(value) OVER w AS a, sum(value) OVER w AS s, var_samp(value) OVER w AS v, min(value) OVER w AS lo, max(value) OVER w AS hi FROM events
 WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id), w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 9 PRECEDING))
 SELECT user_id, event_id, round(a, 9) AS rolling_mean, round(s, 5) AS rolling_sum, round(v, 7) AS rolling_variance, lo AS rolling_min, hi AS rolling_max FROM s WHERE seq >= 9""")
def rolling_stats(spark, d):
    x = rt.rolling(_events(spark, d), "value", 10, ["mean", "sum", "variance", "min", "max"], USER, BY_TIME)
    x = x.select("user_id", "event_id", F.round("rolling_mean", 9).alias("rolling_mean"), F.round("rolling_sum", 5).alias("rolling_sum"), F.round("rolling_variance", 7).alias("rolling_variance"), "rolling_min", "rolling_max")
    return x


@register("expanding_mean", "WITH s AS (SELECT user_id, event_id, row_number() OVER w - 1 AS seq, avg(value) OVER w AS a FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, event_id, round(a, 9) AS expanding_mean FROM s WHERE seq >= 19")
def expanding_mean(spark, d):
    return _rounded(rt.expanding(_events(spark, d), "value", 20, ["mean"], USER, BY_TIME).select("user_id", "event_id", "expanding_mean"), 9)


@register("rolling_apply_median", "WITH s AS (SELECT user_id, event_id, row_number() OVER o - 1 AS seq, median(value) OVER w AS a FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id), w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 6 PRECEDING)) SELECT user_id, event_id, round(a, 6) AS med FROM s WHERE seq >= 6")
def rolling_apply_median(spark, d):
    import pandas as pd

    def med(v: pd.Series) -> float:
        return float(v.median())

    return _rounded(rt.rolling_apply(_events(spark, d), "value", 7, med, USER, BY_TIME, "med").select("user_id", "event_id", "med"))


@register("expanding_apply_range", "WITH s AS (SELECT user_id, event_id, row_number() OVER w - 1 AS seq, max(value) OVER w - min(value) OVER w AS a FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, event_id, round(a, 6) AS width FROM s WHERE seq >= 9")
def expanding_apply_range(spark, d):
    return _rounded(rt.expanding_apply(_events(spark, d), "value", 10, lambda v: float(v.max() - v.min()), USER, BY_TIME, "width").select("user_id", "event_id", "width"))


@register("event_study", f"""WITH {SERIES}, e AS (SELECT s.user_id, s.event_id, s.seq FROM s JOIN events USING (event_id) WHERE s.seq > 0 AND event_type = 'error'), w AS (SELECT e.user_id, e.event_id, o.k, coalesce(r0.r, 0) AS ret FROM e CROSS JOIN (SELECT unnest(generate_series(-5, 5)) AS k) o LEFT JOIN r0 ON r0.user_id = e.user_id AND r0.seq = e.seq + o.k),
c AS (SELECT *, sum(ret) OVER (PARTITION BY user_id, event_id ORDER BY k) AS car FROM w)
SELECT k::BIGINT AS "offset", count(*) AS n_events, {_r('avg(ret)', 'mean_ar')}, {_r('avg(car)', 'mean_car')}, {_r('coalesce(stddev_samp(ret), 0)', 'volatility')} FROM c GROUP BY 1""")
def event_study(spark, d):
    r = _returns(spark, d)
    return _rounded(realized.event_study(r, r.filter("event_type = 'error'").select("user_id", "event_id", "seq"), "r", USER, 5, 5))


@register("ols_simple", f"""WITH {LINES}, f AS (SELECT count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy, avg(x) AS mx FROM l),
g AS (SELECT *, syy - b * sxy AS ssr, (syy - b * sxy) / (n - 2) AS s2 FROM f)
SELECT 'const' AS term, {_r('a', 'beta')}, {_r('sqrt(s2 * (1.0 / n + mx * mx / sxx))', 'se')}, {_r('1 - ssr / syy', 'r2')}, n FROM g UNION ALL SELECT 'x', round(b, 6), round(sqrt(s2 / sxx), 6), round(1 - ssr / syy, 6), n FROM g""")
def ols_simple(spark, d):
    return _rounded(rg.ols(_lines(spark, d), "y", ["x"]).select("term", "beta", "se", "r2", "n"))


WHITE = f"WITH {LINES}, f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_sxx(y, x) AS sxx, avg(x) AS mx FROM l), e AS (SELECT l.*, y - a - b * x AS e, mx, sxx, b FROM l, f)"


@register("ols_white", regression(LINES, "l", "y", ["1.0", "x"], ["const", "x"], "white"))
def ols_white(spark, d):
    return _rounded(rg.ols(_lines(spark, d), "y", ["x"], cov="white").select("term", "beta", "se", "n"))


@register("ols_clustered", regression(LINES, "l", "y", ["1.0", "x"], ["const", "x"], "cluster", clusters=["l_suppkey"]))
def ols_clustered(spark, d):
    return _rounded(rg.ols(_lines(spark, d), "y", ["x"], cov="cluster", cluster=["l_suppkey"]).select("term", "beta", "se", "n"))


@register("ols_two_way_clustered", regression("l AS (SELECT l_extendedprice / 1e4 AS y, l_quantity / 10 AS x, l_suppkey, l_partkey FROM lineitem)", "l", "y", ["1.0", "x"], ["const", "x"], "cluster", clusters=["l_suppkey", "l_partkey"]))
def ols_two_way_clustered(spark, d):
    x = read_table(spark, d, "lineitem").select((F.col("l_extendedprice") / 1e4).alias("y"), (F.col("l_quantity") / 10).alias("x"), "l_suppkey", "l_partkey")
    return _rounded(rg.ols(x, "y", ["x"], cov="cluster", cluster=["l_suppkey", "l_partkey"]).select("term", "beta", "se", "n"))


@register("ols_newey_west", regression(DAILY, "ds", "y", ["1.0", "c"], ["const", "c"], "newey_west", "seq", "12"))
def ols_newey_west(spark, d):
    return _rounded(rg.ols(_daily(spark, d), "y", ["c"], cov="newey_west", order=["day"], max_lag=12).select("term", "beta", "se", "n"))


@register("batched_ols", f"""WITH {SERIES}, g AS (SELECT user_id, count(*) AS n, regr_slope(r, r1) AS b, regr_intercept(r, r1) AS a, regr_sxx(r, r1) AS sxx, regr_syy(r, r1) AS syy, regr_sxy(r, r1) AS sxy FROM r WHERE r IS NOT NULL AND r1 IS NOT NULL GROUP BY 1)
SELECT user_id, {_r('a', 'intercept')}, {_r('b', 'slope')}, {_r('sqrt((syy - b * sxy) / (n - 2) / sxx)', 'slope_se')}, n FROM g""")
def batched_ols(spark, d):
    x = _returns(spark, d)
    from .plans.frame import lags

    f = rg.batched_ols(lags(x, ["r"], 1, USER, BY_TIME), USER, "r", ["r_lag1"])
    w = f.groupBy("user_id").agg(*[F.max(F.when(F.col("term") == t, F.col(c))).alias(a) for t, c, a in (("const", "beta", "intercept"), ("r_lag1", "beta", "slope"), ("r_lag1", "se", "slope_se"))], F.max("n").alias("n"))
    return _rounded(w)


@register("batched_ols_columns", f"WITH {LINES} SELECT 'y' AS y, {_r('regr_slope(y, x)', 'slope')} FROM l UNION ALL SELECT 'z', round(regr_slope(z, x), 6) FROM l")
def batched_ols_columns(spark, d):
    return _rounded(rg.batched_ols_columns(_lines(spark, d), ["y", "z"], ["x"]).filter("term = 'x'").select("y", F.col("beta").alias("slope")))


@register("rolling_ols", """WITH s AS (SELECT user_id, row_number() OVER o - 1 AS seq, value, event_id FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
t AS (SELECT user_id, seq AS end_seq, regr_slope(value, seq / 10.0) OVER w AS b, regr_intercept(value, seq / 10.0) OVER w AS a FROM s WINDOW w AS (PARTITION BY user_id ORDER BY seq ROWS 19 PRECEDING))
SELECT user_id, end_seq::BIGINT AS end_seq, round(a, 4) AS intercept, round(b, 5) AS slope FROM t WHERE end_seq >= 19""")
def rolling_ols(spark, d):
    from .plans.frame import with_seq

    x = with_seq(_events(spark, d), USER, BY_TIME, "k").withColumn("x", F.col("k") / 10.0)
    f = rg.rolling_ols(x, "value", ["x"], 20, USER, BY_TIME)
    w = f.groupBy("user_id", "end_seq").agg(*[F.max(F.when(F.col("term") == t, F.col("beta"))).alias(a) for t, a in (("const", "intercept"), ("x", "slope"))])
    return w.select("user_id", "end_seq", F.round("intercept", 4).alias("intercept"), F.round("slope", 5).alias("slope"))


@register("rolling_ols_white", """WITH s AS (SELECT user_id, row_number() OVER o - 1 AS seq, value AS y FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
w AS (SELECT a.user_id, a.seq AS end_seq, b.seq / 10.0 AS x, b.y FROM s a JOIN s b ON a.user_id = b.user_id AND b.seq BETWEEN a.seq - 29 AND a.seq WHERE a.seq >= 29),
f AS (SELECT user_id, end_seq, regr_slope(y, x) AS b, avg(x) AS mx, avg(y) AS my, regr_sxx(y, x) AS sxx FROM w GROUP BY 1, 2)
SELECT user_id, end_seq::BIGINT AS end_seq, round(max(f.b), 5) AS slope, round(sqrt(sum(pow((w.y - my - f.b * (w.x - mx)) * (w.x - mx), 2))) / max(sxx), 5) AS slope_se FROM w JOIN f USING (user_id, end_seq) GROUP BY 1, 2""")
def rolling_ols_white(spark, d):
    from .plans.frame import with_seq

    x = with_seq(_events(spark, d), USER, BY_TIME, "k").withColumn("x", F.col("k") / 10.0)
    f = rg.rolling_ols(x, "value", ["x"], 30, USER, BY_TIME, cov="white").filter("term = 'x'")
    return f.select("user_id", "end_seq", F.round("beta", 5).alias("slope"), F.round("se", 5).alias("slope_se"))


@register("expanding_ols", """WITH s AS (SELECT user_id, row_number() OVER o - 1 AS seq, value FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
t AS (SELECT user_id, seq AS end_seq, regr_slope(value, seq / 10.0) OVER w AS b FROM s WINDOW w AS (PARTITION BY user_id ORDER BY seq))
SELECT user_id, end_seq::BIGINT AS end_seq, round(b, 5) AS slope FROM t WHERE end_seq >= 29""")
def expanding_ols(spark, d):
    from .plans.frame import with_seq

    x = with_seq(_events(spark, d), USER, BY_TIME, "k").withColumn("x", F.col("k") / 10.0)
    return _rounded(rg.expanding_ols(x, "value", ["x"], 30, USER, BY_TIME).filter("term = 'x'").select("user_id", "end_seq", F.col("beta").alias("slope")), 5)


@register("fgls", f"""WITH {LINES}, f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM l), e AS (SELECT l.x, l.y, 1 / greatest((y - a - b * x) * (y - a - b * x), 1e-15) AS w FROM l, f),
m AS (SELECT sum(w) AS sw, sum(w * x) AS sx, sum(w * y) AS sy FROM e), c AS (SELECT sum(w * (x - sx / sw) * (y - sy / sw)) / sum(w * (x - sx / sw) * (x - sx / sw)) AS b, max(sx / sw) AS mx, max(sy / sw) AS my FROM e, m)
SELECT 'x' AS term, {_r('b', 'beta', 4)} FROM c UNION ALL SELECT 'const', round(my - b * mx, 4) FROM c""")
def fgls(spark, d):
    return _rounded(rg.fgls(_lines(spark, d), "y", ["x"]).select("term", "beta"), 4)


@register("gls", regression(DAILY + ", a AS (SELECT seq, y, c, lag(y) OVER (ORDER BY seq) AS y1, lag(c) OVER (ORDER BY seq) AS c1 FROM ds), p AS (SELECT CASE WHEN seq = 0 THEN sqrt(0.91) * y ELSE y - 0.3 * y1 END AS y, CASE WHEN seq = 0 THEN sqrt(0.91) ELSE 0.7 END AS one, CASE WHEN seq = 0 THEN sqrt(0.91) * c ELSE c - 0.3 * c1 END AS c FROM a)",
                            "p", "y", ["one", "c"], ["const", "c"]))
def gls(spark, d):
    """Errors with correlation 0.3 ** |i - j|: the series of days, whose length is that of the calendar."""
    import numpy as np

    x = _daily(spark, d).orderBy("day").toPandas()
    n = len(x)
    omega = 0.3 ** np.abs(np.subtract.outer(np.arange(n), np.arange(n)))
    f = rg.gls(x["y"].to_numpy(), np.column_stack([np.ones(n), x["c"]]), omega)
    return _rounded(spark.createDataFrame([(t, float(b), float(s), n) for t, b, s in zip(("const", "c"), f["beta"], f["se"])], "term string, beta double, se double, n long"))


@register("fgls_modelled", f"""WITH {LINES}, f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM l), e AS (SELECT l.x, l.y, ln(greatest((y - a - b * x) * (y - a - b * x), 1e-15)) AS le FROM l, f),
h AS (SELECT regr_slope(le, x) AS b, regr_intercept(le, x) AS a FROM e), q AS (SELECT x, y, exp(-(h.a + h.b * x)) AS w FROM e, h), m AS (SELECT sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM q),
c AS (SELECT sum(w * (x - mx) * (y - my)) / sum(w * (x - mx) * (x - mx)) AS b, max(mx) AS mx, max(my) AS my FROM q, m) SELECT 'x' AS term, {_r('b', 'beta', 5)} FROM c UNION ALL SELECT 'const', round(my - b * mx, 5) FROM c""")
def fgls_modelled(spark, d):
    return _rounded(rg.fgls(_lines(spark, d), "y", ["x"], method="modelled").select("term", "beta"), 5)


IV_FIT = f"{LINES}, p AS (SELECT y, x, z, z * z AS z2 FROM l), c AS (SELECT y, x, z - avg(z) OVER () AS z, z2 - avg(z2) OVER () AS w, x - avg(x) OVER () AS dx FROM p), o AS (SELECT y, x, z, dx, w - z * (sum(w * z) OVER () / sum(z * z) OVER ()) AS w FROM c)"


def _iv_sql(fitted: str, robust: bool) -> str:
    """Two-stage least squares of y on x, given what instruments say of x about its mean."""
    meat = "sum(e * e * (h - mh) * (h - mh))" if robust else "sum(e * e) / (count(*) - 2) * sum((h - mh) * (h - mh))"
    return f"""WITH {IV_FIT}, h AS (SELECT y, x, avg(x) OVER () + {fitted} AS h FROM o), m AS (SELECT *, avg(h) OVER () AS mh, avg(y) OVER () AS my, avg(x) OVER () AS mx FROM h),
b AS (SELECT sum((h - mh) * (y - my)) / sum((h - mh) * (h - mh)) AS b FROM m), e AS (SELECT m.*, b.b, y - my - b.b * (x - mx) AS e FROM m, b)
SELECT 'x' AS term, round(max(b), 4) AS beta, round(sqrt({meat}) / sum((h - mh) * (h - mh)), 4) AS se, count(*) AS n FROM e"""


@register("iv_2sls", _iv_sql("z * (sum(dx * z) OVER () / sum(z * z) OVER ())", False))
def iv_2sls(spark, d):
    return _rounded(rg.iv_2sls(_lines(spark, d), "y", ["x"], ["z"]).filter("term = 'x'").select("term", "beta", "se", "n"), 4)


@register("iv_2sls_white", _iv_sql("z * (sum(dx * z) OVER () / sum(z * z) OVER ()) + w * (sum(dx * w) OVER () / sum(w * w) OVER ())", True))
def iv_2sls_white(spark, d):
    x = _lines(spark, d).withColumn("z2", F.col("z") * F.col("z"))
    return _rounded(rg.iv_2sls(x, "y", ["x"], ["z", "z2"], cov="white").filter("term = 'x'").select("term", "beta", "se", "n"), 4)


@register("iv_2sls_newey_west", f"""WITH {DAILY}, a AS (SELECT seq, y, c AS x, lag(c) OVER (ORDER BY seq) AS z FROM ds), p AS (SELECT seq, y - avg(y) OVER () AS y, x - avg(x) OVER () AS x, z - avg(z) OVER () AS z FROM a WHERE z IS NOT NULL),
b AS (SELECT sum(z * y) / sum(z * x) AS b, sum(z * x) AS zx FROM p), u AS (SELECT seq, z * (y - b * x) AS u FROM p, b), m AS (SELECT sum(a.u * b.u * (1 - abs(a.seq - b.seq) / 13.0)) AS m FROM u a JOIN u b ON abs(a.seq - b.seq) <= 12)
SELECT 'c' AS term, {_r('b', 'beta', 4)}, {_r('sqrt(m) / abs(zx)', 'se', 4)} FROM b, m""")
def iv_2sls_newey_west(spark, d):
    from .plans.frame import lags

    x = lags(_daily(spark, d), ["c"], 1, ["one"], ["day"])
    return _rounded(rg.iv_2sls(x, "y", ["c"], ["c_lag1"], cov="newey_west", order=["day"], max_lag=12).filter("term = 'c'").select("term", "beta", "se"), 4)


PANEL = "o AS (SELECT o_custkey, date_diff('month', DATE '1990-01-01', o_orderdate::DATE) AS m, o_totalprice / 1e5 AS y, (length(o_orderpriority) + o_orderkey % 7) / 1.0 AS x FROM orders)"


def _panel(spark, d):
    o = read_table(spark, d, "orders")
    months = ((F.year("o_orderdate") - 1990) * 12 + F.month("o_orderdate") - 1).cast("long")
    return o.select("o_custkey", months.alias("m"), (F.col("o_totalprice") / 1e5).alias("y"), ((F.length("o_orderpriority") + F.col("o_orderkey") % 7) / 1.0).alias("x"))


@register("fixed_effects", f"""WITH {PANEL}, w AS (SELECT o_custkey, y - avg(y) OVER p AS y, x - avg(x) OVER p AS x FROM o WINDOW p AS (PARTITION BY o_custkey)), b AS (SELECT sum(x * y) / sum(x * x) AS b, sum(x * x) AS sxx FROM w),
k AS (SELECT o_custkey, sum((y - b * x) * x) AS u, count(*) AS n, max(b) AS b, max(sxx) AS sxx FROM w, b GROUP BY 1)
SELECT 'x' AS term, {_r('max(b)', 'beta')}, {_r('sqrt(sum(u * u) * count(*) / (count(*) - 1) * (sum(n) - 1) / (sum(n) - 1)) / max(sxx)', 'se')} FROM k""")
def fixed_effects(spark, d):
    return _rounded(panel.fixed_effects(_panel(spark, d), "y", ["x"], "o_custkey", "m").select("term", "beta", "se"))


def _two_way_sql(rounds: int = 20) -> str:
    ctes, now = [], "o"
    for k in range(2 * rounds):
        by = "m" if k % 2 else "o_custkey"
        ctes.append(f"p{k} AS (SELECT o_custkey, m, y - avg(y) OVER (PARTITION BY {by}) AS y, x - avg(x) OVER (PARTITION BY {by}) AS x FROM {now})")
        now = f"p{k}"
    meat = lambda by: f"(SELECT sum(u * u) * count(*) / (count(*) - 1.0) FROM (SELECT sum(u) AS u FROM e GROUP BY {by}))"
    return f"""WITH {PANEL}, {', '.join(ctes)}, b AS (SELECT sum(x * y) / sum(x * x) AS b, sum(x * x) AS sxx FROM {now}), e AS (SELECT o_custkey, m, (y - b * x) * x AS u FROM {now}, b)
SELECT 'x' AS term, {_r('b', 'beta')}, {_r(f"sqrt({meat('o_custkey')} + {meat('m')} - {meat('o_custkey, m')}) / sxx", 'se')} FROM b"""


@register("fixed_effects_two_way", _two_way_sql())
def fixed_effects_two_way(spark, d):
    return _rounded(panel.fixed_effects(_panel(spark, d), "y", ["x"], "o_custkey", "m", effects="twoway", cov="both").select("term", "beta", "se"))


@register("count_unique", "SELECT count(DISTINCT o_custkey) AS n FROM orders")
def count_unique(spark, d):
    return panel.count_unique(read_table(spark, d, "orders"), "o_custkey")


@register("fama_macbeth", f"WITH {PANEL}, g AS (SELECT m, regr_slope(y, x) AS b FROM o GROUP BY m HAVING count(*) > 2 AND regr_slope(y, x) IS NOT NULL) SELECT 'x' AS term, {_r('avg(b)', 'gamma')}, {_r('stddev_samp(b) / sqrt(count(*))', 'se')}, count(*) AS n_periods FROM g")
def fama_macbeth(spark, d):
    return _rounded(panel.fama_macbeth(_panel(spark, d), "y", ["x"], "m", intercept=True, hac_lag=0).filter("term = 'x'").select("term", "gamma", "se", "n_periods"))


@register("fama_macbeth_hac", f"""WITH {PANEL}, g AS (SELECT m, regr_slope(y, x) AS x, regr_intercept(y, x) AS c FROM o GROUP BY m HAVING count(*) > 2 AND regr_slope(y, x) IS NOT NULL),
t AS (SELECT 'x' AS term, m, x AS b FROM g UNION ALL SELECT 'const', m, c FROM g), e AS (SELECT term, row_number() OVER (PARTITION BY term ORDER BY m) AS k, b, avg(b) OVER w AS mean, b - avg(b) OVER w AS e, count(*) OVER w AS n, floor(pow(count(*) OVER w, 1 / 3.0)) AS el FROM t WINDOW w AS (PARTITION BY term)),
v AS (SELECT a.term, sum(a.e * b.e * (1 - abs(a.k - b.k) / (a.el + 1.0))) AS v FROM e a JOIN e b ON a.term = b.term AND abs(a.k - b.k) <= a.el GROUP BY 1)
SELECT term, {_r('max(mean)', 'gamma')}, {_r('sqrt(max(v.v)) / max(n)', 'se')}, max(n) AS n_periods FROM e JOIN v USING (term) GROUP BY term""")
def fama_macbeth_hac(spark, d):
    return _rounded(panel.fama_macbeth(_panel(spark, d), "y", ["x"], "m", intercept=True).select("term", "gamma", "se", "n_periods"))


def _labelled(spark, d):
    x = read_table(spark, d, "documents").select("doc_id", F.log(F.col("n_chars") + 1.0).alias("size"))
    return x.join(read_table(spark, d, "labels"), "doc_id")


def _logit_sql(rounds: int = 12) -> str:
    """Newton steps from 0, one CTE each."""
    ctes = ["t AS (SELECT quality::DOUBLE AS y, ln(n_chars + 1.0) AS x FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND n_chars IS NOT NULL)", "b0 AS (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b)"]
    for k in range(rounds):
        p = f"1 / (1 + exp(-(b{k}.a + b{k}.b * x)))"
        ctes.append(f"s{k} AS (SELECT max(b{k}.a) AS a, max(b{k}.b) AS b, sum(y - {p}) AS g0, sum((y - {p}) * x) AS g1, sum({p} * (1 - {p})) AS h00, sum({p} * (1 - {p}) * x) AS h01, sum({p} * (1 - {p}) * x * x) AS h11, sum(ln(CASE WHEN y = 1 THEN {p} ELSE 1 - {p} END)) AS ll, count(*) AS n FROM t, b{k})")
        ctes.append(f"b{k + 1} AS (SELECT a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS a, b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS b FROM s{k})")
    last = f"s{rounds - 1}"
    return f"WITH {', '.join(ctes)} SELECT 'const' AS term, {_r('a', 'beta', 5)}, {_r('sqrt(h11 / (h00 * h11 - h01 * h01))', 'se', 5)}, {_r('ll', 'll', 5)}, n FROM {last} UNION ALL SELECT 'size', round(b, 5), round(sqrt(h00 / (h00 * h11 - h01 * h01)), 5), round(ll, 5), n FROM {last}"


@register("logit", _logit_sql())
def logit(spark, d):
    return _rounded(glm.logit(_labelled(spark, d), "quality", ["size"]).select("term", "beta", "se", "ll", "n"), 5)


@register("probit")
def probit(spark, d):
    return glm.probit(_labelled(spark, d), "quality", ["size"])


@register("ar_1", f"WITH {SERIES}, g AS (SELECT user_id, regr_slope(r, r1) AS b, regr_intercept(r, r1) AS a, count(*) AS n FROM r WHERE r IS NOT NULL AND r1 IS NOT NULL GROUP BY 1) SELECT user_id, {_r('a', 'const')}, {_r('b', 'phi')}, n FROM g")
def ar_1(spark, d):
    f = tseries.ar(_returns(spark, d), "r", 1, USER, BY_TIME, cov="classical")
    return _rounded(f.groupBy("user_id").agg(F.max(F.when(F.col("term") == "const", F.col("beta"))).alias("const"), F.max(F.when(F.col("term") == "r_lag1", F.col("beta"))).alias("phi"), F.max("n").alias("n")))


@register("ar_2_newey_west", regression(DAILY + ", a AS (SELECT *, lag(y) OVER (ORDER BY seq) AS y1, lag(y, 2) OVER (ORDER BY seq) AS y2 FROM ds)", "a", "y", ["1.0", "y1", "y2"], ["const", "y_lag1", "y_lag2"], "newey_west", "seq", AUTO_LAG))
def ar_2_newey_west(spark, d):
    return _rounded(tseries.ar(_daily(spark, d), "y", 2, ["one"], ["day"]).select("term", "beta", "se", "n"))


@register("har_features", f"WITH {DAILY} SELECT CAST(day AS VARCHAR) AS day, round(lag(y) OVER (ORDER BY day), 9) AS rv_1, round(avg(y) OVER (ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 9) AS rv_5, round(avg(y) OVER (ORDER BY day ROWS BETWEEN 22 PRECEDING AND 1 PRECEDING), 9) AS rv_22 FROM ds QUALIFY seq >= 22")
def har_features(spark, d):
    return _rounded(tseries.har_features(_daily(spark, d), "y", ["one"], ["day"]).select(F.col("day").cast("string").alias("day"), "rv_1", "rv_5", "rv_22"), 9)


@register("har_rv", regression(DAILY + ", a AS (SELECT seq, y, lag(y) OVER w AS r1, avg(y) OVER (ORDER BY seq ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS r5, avg(y) OVER (ORDER BY seq ROWS BETWEEN 22 PRECEDING AND 1 PRECEDING) AS r22 FROM ds WINDOW w AS (ORDER BY seq)), f AS (SELECT * FROM a WHERE seq >= 22)",
                               "f", "y", ["1.0", "r1", "r5", "r22"], ["const", "rv_1", "rv_5", "rv_22"], "newey_west", "seq", AUTO_LAG))
def har_rv(spark, d):
    return _rounded(tseries.har_rv(_daily(spark, d), "y", ["one"], ["day"]).select("term", "beta", "se", "n"))


VAR = DAILY + ", a AS (SELECT seq, y, c, lag(y) OVER w AS y1, lag(c) OVER w AS c1, lag(y, 2) OVER w AS y2, lag(c, 2) OVER w AS c2 FROM ds WINDOW w AS (ORDER BY seq))"
VAR_X, VAR_TERMS = ["1.0", "y1", "c1", "y2", "c2"], ["const", "y_lag1", "c_lag1", "y_lag2", "c_lag2"]


def _var_sql(digits: int = 6) -> str:
    one = [regression(VAR, "a", e, VAR_X, VAR_TERMS, digits=digits) for e in ("y", "c")]
    return " UNION ALL ".join(f"SELECT '{e}' AS equation, * FROM ({q}) {e}_" for e, q in zip(("y", "c"), one))


def _responses_sql() -> str:
    """Orthogonal responses p<response><shock> by horizon, of the coefficients above and the residuals' covariance."""
    cell = lambda e, t: f"max(CASE WHEN equation = '{e}' AND term = '{t}' THEN beta END)"
    names = {f"{n}{k}{e}": cell(e, f"{n}_lag{k}") for n in "yc" for k in (1, 2) for e in "yc"} | {f"k{e}": cell(e, "const") for e in "yc"}
    fit = "SELECT " + ", ".join(f"{x} AS {n}" for n, x in names.items()) + f" FROM ({_var_sql(15)}) t"
    resid = lambda e: f"{e} - (k{e} + y1{e} * y1 + c1{e} * c1 + y2{e} * y2 + c2{e} * c2)"
    nxt = lambda i, j: f"f.y1{i} * r.py{j} + f.c1{i} * r.pc{j} + f.y2{i} * r.qy{j} + f.c2{i} * r.qc{j}"
    return f"""WITH RECURSIVE {VAR}, f AS ({fit}), u AS (SELECT {resid('y')} AS uy, {resid('c')} AS uc FROM a, f WHERE y2 IS NOT NULL),
s AS (SELECT sqrt(avg(uy * uy)) AS l11, avg(uy * uc) / sqrt(avg(uy * uy)) AS l21, sqrt(avg(uc * uc) - pow(avg(uy * uc), 2) / avg(uy * uy)) AS l22 FROM u),
r AS (SELECT 0 AS h, l11 AS pyy, 0.0::DOUBLE AS pyc, l21 AS pcy, l22 AS pcc, 0.0::DOUBLE AS qyy, 0.0::DOUBLE AS qyc, 0.0::DOUBLE AS qcy, 0.0::DOUBLE AS qcc FROM s
UNION ALL SELECT h + 1, {nxt('y', 'y')}, {nxt('y', 'c')}, {nxt('c', 'y')}, {nxt('c', 'c')}, pyy, pyc, pcy, pcc FROM r, f WHERE h < 10),
i AS (SELECT h, 'y' AS response, 'y' AS shock, pyy AS value FROM r UNION ALL SELECT h, 'y', 'c', pyc FROM r UNION ALL SELECT h, 'c', 'y', pcy FROM r UNION ALL SELECT h, 'c', 'c', pcc FROM r)"""


@register("var_2", _var_sql())
def var_2(spark, d):
    return _rounded(tseries.var(_daily(spark, d), ["y", "c"], 2, ["day"], ["one"])["table"].select("equation", "term", "beta", "se", "n"))


DAYS = "d AS (SELECT event_type, ts::DATE AS day, avg(value) / 100 AS v, count(*) / 10.0 AS k FROM events GROUP BY 1, 2), a AS (SELECT event_type, day, v, k, lag(v) OVER w AS v1, lag(k) OVER w AS k1 FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day))"


@register("var_by_type", " UNION ALL ".join(f"SELECT '{e}' AS equation, * FROM ({regression(DAYS, 'a', e, ['1.0', 'v1', 'k1'], ['const', 'v_lag1', 'k_lag1'], by=['event_type'], digits=5)}) {e}_" for e in ("v", "k")))
def var_by_type(spark, d):
    x = _events(spark, d).groupBy("event_type", F.col("ts").cast("date").alias("day")).agg((F.avg("value") / 100).alias("v"), (F.count(F.lit(1)) / 10.0).alias("k"))
    return _rounded(tseries.var_systems(x, ["v", "k"], 1, KIND, ["day"]).select("event_type", "equation", "term", "beta", "se", "n"), 5)


@register("var_irf", f"{_responses_sql()} SELECT h, response, shock, {_r('value', 'value')} FROM i")
def var_irf(spark, d):
    return _rounded(tseries.var_irf(spark, tseries.var(_daily(spark, d), ["y", "c"], 2, ["day"], ["one"]), 10))


@register("var_fevd", f"{_responses_sql()}, c AS (SELECT *, sum(value * value) OVER (PARTITION BY response, shock ORDER BY h) AS v FROM i) SELECT h, response, shock, {_r('v / sum(v) OVER (PARTITION BY h, response)', 'share')} FROM c")
def var_fevd(spark, d):
    return _rounded(tseries.var_fevd(spark, tseries.var(_daily(spark, d), ["y", "c"], 2, ["day"], ["one"]), 10))


def _ssr_sql(xs: list[str]) -> str:
    q = regression(VAR, "a", "y", xs, [str(i) for i in range(len(xs))], only=["0"], more="f.ssr AS ssr")
    return f"(SELECT n, ssr FROM ({q}) t)"


@register("granger", f"WITH full_ AS {_ssr_sql(VAR_X)}, part AS (SELECT * FROM {_ssr_sql(['1.0', 'y1', 'y2'])} p) SELECT full_.n AS t, {_r('(part.ssr - full_.ssr) / 2 / (full_.ssr / (full_.n - 5))', 'f')} FROM full_, part")
def granger(spark, d):
    return _rounded(tseries.granger_causality(_daily(spark, d), "y", "c", 2, ["one"], ["day"]).select("t", "f"))


def _projection_sql(horizon: int) -> str:
    parts = []
    for h in range(horizon + 1):
        before = DAILY + f", a AS (SELECT seq, lead(y, {h}) OVER w AS yh, c, lag(y) OVER w AS y1, lag(y, 2) OVER w AS y2, lag(c) OVER w AS c1, lag(c, 2) OVER w AS c2 FROM ds WINDOW w AS (ORDER BY seq))"
        q = regression(before, "a", "yh", ["1.0", "y1", "y2", "c1", "c2", "c"], ["k", "y1", "y2", "c1", "c2", "c"], "newey_west", "seq", str(h + 1), only=["c"])
        parts.append(f"SELECT {h} AS h, beta AS irf, se, n FROM ({q}) h{h}")
    return " UNION ALL ".join(parts)


@register("local_projections", _projection_sql(4))
def local_projections(spark, d):
    return _rounded(tseries.local_projections(_daily(spark, d), "y", "c", 4, ["one"], ["day"]).select("h", "irf", "se", "n"))


@register("forecast_eval", """WITH s AS (SELECT user_id, ts, event_id, value AS a, lag(value) OVER w AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), q AS (SELECT *, 0.5 * f AS g FROM s WHERE f IS NOT NULL), z AS (SELECT *, a - lag(a) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS w FROM q)
SELECT user_id, count(*) AS n, round(avg(abs(a - g)), 5) AS mae, round(avg((a - g) * (a - g)), 3) AS mse, round(sqrt(avg((a - g) * (a - g))), 5) AS rmse, round(sqrt(sum((a - g) * (a - g)) / nullif(sum(w * w), 0)), 6) AS theil_u, round(1 - sum((a - g) * (a - g)) / nullif(var_pop(a) * count(*), 0), 6) AS r2 FROM z GROUP BY 1""")
def forecast_eval(spark, d):
    from .plans.frame import lags

    x = lags(_events(spark, d), ["value"], 1, USER, BY_TIME).filter("value_lag1 is not null").withColumn("g", 0.5 * F.col("value_lag1"))
    f = tseries.forecast_eval(x, "value", "g", USER, BY_TIME)
    return f.select("user_id", "n", F.round("mae", 5).alias("mae"), F.round("mse", 3).alias("mse"), F.round("rmse", 5).alias("rmse"), F.round("theil_u", 6).alias("theil_u"), F.round("r2", 6).alias("r2"))


ARIMA = """s AS (SELECT user_id, ts, event_id, value, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS z FROM events), l AS (SELECT *, lag(z) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS z1 FROM s),
f AS (SELECT user_id, regr_slope(z, z1) AS phi, regr_intercept(z, z1) AS c, (regr_syy(z, z1) - regr_slope(z, z1) * regr_sxy(z, z1)) / (count(*) - 2) AS s2, count(*) AS n FROM l WHERE z1 IS NOT NULL GROUP BY 1 HAVING count(*) >= 10)"""


@register("arima_110", f"WITH {ARIMA} SELECT user_id, round(c, 5) AS const, round(phi, 6) AS phi, round(s2, 3) AS sigma2, n FROM f")
def arima_110(spark, d):
    f = tseries.arima(_events(spark, d), "value", 1, 1, 0, USER, BY_TIME).filter("status = 'ok'")
    return f.select("user_id", F.round("const", 5).alias("const"), F.round(F.get("ar", F.lit(0)), 6).alias("phi"), F.round("sigma2", 3).alias("sigma2"), "n")


@register("arima_111")
def arima_111(spark, d):
    return tseries.arima(_events(spark, d), "value", 1, 1, 1, ["event_type"], BY_TIME)


@register("arima_forecast", f"""WITH RECURSIVE {ARIMA}, e AS (SELECT user_id, arg_max(value, k) AS y, arg_max(z, k) AS z FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM s) t GROUP BY 1),
r AS (SELECT user_id, 0 AS h, z, y, 0.0::DOUBLE AS psi, 0.0::DOUBLE AS v, c, phi, s2 FROM e JOIN f USING (user_id) UNION ALL SELECT user_id, h + 1, c + phi * z, y + c + phi * z, 1 + phi * psi, v + (1 + phi * psi) * (1 + phi * psi), c, phi, s2 FROM r WHERE h < 5)
SELECT user_id, h::BIGINT AS h, round(y, 4) AS forecast, round(y - 1.959963984540054 * sqrt(s2 * v), 4) AS lower, round(y + 1.959963984540054 * sqrt(s2 * v), 4) AS upper FROM r WHERE h > 0""")
def arima_forecast(spark, d):
    return _rounded(tseries.arima_forecast(_events(spark, d), "value", 1, 1, 0, 5, USER, BY_TIME), 4)


for _kind in ("garch", "gjr", "egarch", "garch_t"):

    def _fit(spark, d, kind=_kind):
        return vol.volatility_model(_returns(spark, d), "r", USER, BY_TIME, kind)

    register(f"volatility_{_kind}")(_fit)


@register("garch_paths")
def garch_paths(spark, d):
    return vol.volatility_model(_returns(spark, d), "r", ["event_type"], BY_TIME, "garch", paths=True)


@register("garch_likelihood", f"""WITH RECURSIVE {SERIES}, m AS (SELECT user_id, avg(r) AS mu FROM r0 GROUP BY 1), e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, r - mu AS e FROM r0 JOIN m USING (user_id) WHERE r IS NOT NULL),
h AS (SELECT user_id, k, e, 0.1 / (1 - 0.1 - 0.8) AS h FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.k, e.e, 0.1 + 0.1 * h.e * h.e + 0.8 * h.h FROM h JOIN e ON e.user_id = h.user_id AND e.k = h.k + 1)
SELECT user_id, round(sum(-0.5 * (ln(2 * pi()) + ln(h) + e * e / h)), 5) AS ll FROM h GROUP BY 1""")
def garch_likelihood(spark, d):
    return _rounded(vol.garch_likelihood_grid(_returns(spark, d), "r", USER, BY_TIME, [(0.1, 0.1, 0.8)]).select("user_id", "ll"), 5)


@register("multiplicative_garch")
def multiplicative_garch(spark, d):
    x = _returns(spark, d).withColumn("rv", F.col("r") ** 2).filter("r is not null")
    return vol.multiplicative_garch(x, "r", "rv", USER, BY_TIME)


@register("rolling_multiplicative_garch")
def rolling_multiplicative_garch(spark, d):
    x = _returns(spark, d).withColumn("rv", F.col("r") ** 2).filter("r is not null")
    return vol.rolling_multiplicative_garch(x, "r", "rv", ["event_type"], BY_TIME, 252, 21)


@register("descriptive_stats", """WITH m AS (SELECT event_type, count(value) AS n, avg(value) AS mean, var_samp(value) AS v, var_pop(value) AS vp, kurtosis_pop(value) AS ku, min(value) AS lo, max(value) AS hi, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q5, quantile_cont(value, 0.75) AS q75 FROM events GROUP BY 1),
k AS (SELECT event_type, avg(pow(value - mean, 3)) / pow(max(vp), 1.5) AS sk FROM events JOIN m USING (event_type) GROUP BY 1)
SELECT event_type, n, round(mean, 5) AS mean, round(v, 3) AS variance, round(sqrt(v), 5) AS std, round(sk, 5) AS skewness, round(ku, 5) AS kurtosis, lo AS min, hi AS max, round(q25, 5) AS q25, round(q5, 5) AS median, round(q75, 5) AS q75 FROM m JOIN k USING (event_type)""")
def descriptive_stats(spark, d):
    x = dg.descriptive_stats(_events(spark, d), "value", ["event_type"])
    return x.select(*[F.round(c, 3 if c == "variance" else 5).alias(c) if c not in ("event_type", "n", "min", "max") else F.col(c) for c in x.columns])


MOMENTS = "m AS (SELECT user_id, count(value) AS n, avg(value) AS mean, var_pop(value) AS vp, kurtosis_pop(value) AS ku FROM events GROUP BY 1), k AS (SELECT user_id, avg(pow(value - mean, 3)) / pow(max(vp), 1.5) AS sk FROM events JOIN m USING (user_id) GROUP BY 1)"


@register("jarque_bera", f"WITH {MOMENTS} SELECT user_id, n, {_r('n / 6.0 * (sk * sk + ku * ku / 4)', 'statistic', 5)}, {_r('exp(-n / 12.0 * (sk * sk + ku * ku / 4))', 'p')} FROM m JOIN k USING (user_id) WHERE n >= 8")
def jarque_bera(spark, d):
    x = dg.jarque_bera(_events(spark, d), "value", USER)
    return x.select("user_id", "n", F.round("statistic", 5).alias("statistic"), F.round("p", 6).alias("p"))


@register("durbin_watson", f"WITH {SERIES} SELECT user_id, count(r) AS n, {_r('sum((r - r1) * (r - r1)) / sum(r * r)', 'statistic')} FROM r GROUP BY 1 HAVING count(r) >= 3")
def durbin_watson(spark, d):
    return _rounded(dg.durbin_watson(_returns(spark, d), "r", USER, BY_TIME))


ACF = "c AS (SELECT user_id, ts, event_id, value - avg(value) OVER (PARTITION BY user_id) AS x FROM events), a AS (SELECT user_id, x, lag(x) OVER w AS x1, lag(x, 2) OVER w AS x2, lag(x, 3) OVER w AS x3 FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), q AS (SELECT user_id, count(*) AS n, sum(x * x1) / sum(x * x) AS a1, sum(x * x2) / sum(x * x) AS a2, sum(x * x3) / sum(x * x) AS a3 FROM a GROUP BY 1)"


@register("autocorrelation", f"WITH {ACF} SELECT user_id, n, 1::BIGINT AS lag, {_r('a1', 'acf')} FROM q UNION ALL SELECT user_id, n, 2, round(a2, 6) FROM q UNION ALL SELECT user_id, n, 3, round(a3, 6) FROM q")
def autocorrelation(spark, d):
    return _rounded(dg.autocorrelation(_events(spark, d), "value", 3, USER, BY_TIME))


@register("ljung_box", f"WITH {ACF} SELECT user_id, n, {_r('n * (n + 2.0) * (a1 * a1 / (n - 1) + a2 * a2 / (n - 2) + a3 * a3 / (n - 3))', 'statistic', 5)} FROM q")
def ljung_box(spark, d):
    return _rounded(dg.ljung_box(_events(spark, d), "value", 3, USER, BY_TIME).select("user_id", "n", "statistic"), 5)


@register("arch_lm", f"""WITH {SERIES}, e AS (SELECT user_id, r * r AS y, r1 * r1 AS x FROM r WHERE r IS NOT NULL AND r1 IS NOT NULL) SELECT user_id, count(*) AS t, {_r('count(*) * regr_r2(y, x)', 'statistic')} FROM e GROUP BY 1""")
def arch_lm(spark, d):
    return _rounded(dg.arch_lm(_returns(spark, d), "r", 1, USER, BY_TIME).select("user_id", "t", "statistic"))


@register("breusch_pagan", f"{WHITE}, u AS (SELECT x, e * e / avg(e * e) OVER () AS g FROM e) SELECT {_r('regr_r2(g, x) * regr_syy(g, x) / 2', 'statistic', 5)}, 1::BIGINT AS df FROM u")
def breusch_pagan(spark, d):
    e = rg.residuals(_lines(spark, d), "y", ["x"])
    return _rounded(dg.breusch_pagan(e, "resid", ["x"]).select("statistic", "df"), 5)


@register("white_test", f"WITH r AS (SELECT x, z, e FROM (WITH {LINES}, c AS (SELECT y - avg(y) OVER () AS y, x - avg(x) OVER () AS x, z - avg(z) OVER () AS z, x AS x0, z AS z0 FROM l), o AS (SELECT *, z - x * (sum(z * x) OVER () / sum(x * x) OVER ()) AS w FROM c) SELECT x0 AS x, z0 AS z, y - x * (sum(y * x) OVER () / sum(x * x) OVER ()) - w * (sum(y * w) OVER () / sum(w * w) OVER ()) AS e FROM o) q), "
          f"f AS ({regression('', 'r', 'e * e', ['1.0', 'x', 'z', 'x * x', 'x * z', 'z * z'], list('abcdef'), only=['f'], more='f.ssr AS ssr')}), t AS (SELECT count(*) AS n, var_pop(e * e) * count(*) AS tss FROM r) SELECT {_r('t.n * (1 - ssr / tss)', 'statistic', 3)}, 5::BIGINT AS df FROM f, t")
def white_test(spark, d):
    return _rounded(dg.white_test(rg.residuals(_lines(spark, d), "y", ["x", "z"]), "resid", ["x", "z"]).select("statistic", "df"), 3)


ADF = DAILY + ", b AS (SELECT seq, y - lag(y) OVER (ORDER BY seq) AS dy, lag(y) OVER (ORDER BY seq) AS y1 FROM ds), a AS (SELECT *, " + ", ".join(f"lag(dy, {k}) OVER (ORDER BY seq) AS l{k}" for k in range(1, 6)) + " FROM b)"


@register("adf_test", f"SELECT 5::BIGINT AS lags, {_r('beta / se', 'statistic', 4)} FROM ({regression(ADF, 'a', 'dy', ['1.0', *[f'l{k}' for k in range(1, 6)], 'y1'], [*'abcdef', 'y1'], only=['y1'], digits=15)}) t")
def adf_test(spark, d):
    return _rounded(dg.adf_test(_daily(spark, d), "y", ["one"], ["day"], max_lag=5).select("lags", "statistic"), 4)


@register("adf_test_auto")
def adf_test_auto(spark, d):
    return dg.adf_test(_daily(spark, d), "y", ["one"], ["day"])


KPSS = f"WITH {DAILY}, e AS (SELECT seq, y - avg(y) OVER () AS e FROM ds), s AS (SELECT seq, e, sum(e) OVER (ORDER BY seq) AS s, lag(e) OVER (ORDER BY seq) AS e1, lag(e, 2) OVER (ORDER BY seq) AS e2 FROM e) SELECT count(*) AS n, round(sum(s * s) / count(*) / (sum(e * e) + 2 * (2 / 3.0) * sum(e * e1) + 2 * (1 / 3.0) * sum(e * e2)), 6) AS statistic FROM s"


@register("kpss_test", KPSS)
def kpss_test(spark, d):
    return _rounded(dg.kpss_test(_daily(spark, d), "y", ["one"], ["day"], n_lags=2).select("n", "statistic"))


@register("var_historical", f"WITH {SERIES}, k AS (SELECT user_id, r, row_number() OVER (PARTITION BY user_id ORDER BY r) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM r0 WHERE r IS NOT NULL) SELECT user_id, max(n) AS n, {_r('-max(r)', 'var')}, {_r('-avg(r)', 'cvar')} FROM k WHERE k <= floor((1 - 0.95::DOUBLE) * n) GROUP BY 1")
def var_historical(spark, d):
    return _rounded(risk.value_at_risk(_returns(spark, d), "r", USER))


@register("var_parametric", f"WITH {SERIES}, m AS (SELECT user_id, count(r) AS n, avg(r) AS m, stddev_samp(r) AS s FROM r0 WHERE r IS NOT NULL GROUP BY 1) SELECT user_id, n, {_r('-(m - 1.6448536269514726 * s)', 'var')}, {_r('-(m - s * 0.10313564037537128 / 0.05)', 'cvar')} FROM m")
def var_parametric(spark, d):
    return _rounded(risk.value_at_risk(_returns(spark, d), "r", USER, method="parametric"))


@register("var_cornish_fisher", f"""WITH {SERIES}, m AS (SELECT user_id, count(r) AS n, avg(r) AS m, stddev_samp(r) AS s, var_pop(r) AS v FROM r0 WHERE r IS NOT NULL GROUP BY 1),
k AS (SELECT user_id, avg(pow(r - m, 3)) / pow(max(v), 1.5) AS sk, avg(pow(r - m, 4)) / pow(max(v), 2) - 3 AS ku FROM r0 JOIN m USING (user_id) WHERE r IS NOT NULL GROUP BY 1),
q AS (SELECT user_id, n, -(m + s * (-1.6448536269514726 + (pow(1.6448536269514726, 2) - 1) / 6 * sk + (pow(-1.6448536269514726, 3) + 3 * 1.6448536269514726) / 24 * ku - (2 * pow(-1.6448536269514726, 3) + 5 * 1.6448536269514726) / 36 * sk * sk)) AS var FROM m JOIN k USING (user_id)),
t AS (SELECT user_id, -avg(r) AS cvar FROM r0 JOIN q USING (user_id) WHERE r <= -var GROUP BY 1) SELECT q.user_id, n, {_r('var', 'var', 5)}, {_r('coalesce(cvar, var)', 'cvar', 5)} FROM q LEFT JOIN t USING (user_id)""")
def var_cornish_fisher(spark, d):
    return _rounded(risk.value_at_risk(_returns(spark, d), "r", USER, method="cornish_fisher"), 5)


DRAW = f"{SERIES}, q AS (SELECT user_id, row_number() OVER w - 1 AS k, r, sum(r) OVER w AS c FROM r0 WHERE r IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), x AS (SELECT *, max(c) OVER (PARTITION BY user_id ORDER BY k) - c AS dd FROM q)"


@register("drawdown", f"""WITH {DRAW}, t AS (SELECT user_id, count(*) AS n, max(dd) AS worst, avg(dd) AS mean FROM x GROUP BY 1), l AS (SELECT x.user_id, min(k) AS trough FROM x JOIN t USING (user_id) WHERE round(dd, 12) = round(worst, 12) GROUP BY 1),
m AS (SELECT *, max(c) OVER (PARTITION BY user_id ORDER BY k) AS top FROM x), p AS (SELECT m.user_id, max(k) AS peak FROM m JOIN l USING (user_id) WHERE k <= trough AND c = top GROUP BY 1), h AS (SELECT m.user_id, max(top) AS top FROM m JOIN l USING (user_id) WHERE k = trough GROUP BY 1),
rec AS (SELECT x.user_id, min(k) AS back FROM x JOIN l USING (user_id) JOIN h USING (user_id) WHERE k > trough AND c >= top GROUP BY 1)
SELECT user_id, n, {_r('worst', 'max_drawdown')}, {_r('mean', 'avg_drawdown')}, peak::BIGINT AS peak, trough::BIGINT AS trough, coalesce(back, n)::BIGINT AS recovery, (trough - peak)::BIGINT AS duration FROM t JOIN l USING (user_id) JOIN p USING (user_id) LEFT JOIN rec USING (user_id)""")
def drawdown(spark, d):
    return _rounded(risk.drawdown_analysis(_returns(spark, d), "r", USER, BY_TIME))


@register("performance_metrics", f"""WITH {DRAW}, a AS (SELECT user_id, count(*) AS n, avg(r) AS m, stddev_samp(r) AS s, sqrt(sum(CASE WHEN r < 0 THEN r * r ELSE 0 END) / count(*)) AS d, sum(CASE WHEN r > 0 THEN r ELSE 0 END) AS g, sum(CASE WHEN r < 0 THEN -r ELSE 0 END) AS l, max(dd) AS mdd FROM x GROUP BY 1 HAVING count(*) >= 10)
SELECT user_id, n, {_r('m * 252', 'annual_return', 5)}, {_r('s * sqrt(252)', 'annual_volatility', 5)}, {_r('m / s * sqrt(252)', 'sharpe', 5)}, {_r('m / CASE WHEN d > 0 THEN d ELSE s END * sqrt(252)', 'sortino', 5)}, {_r('CASE WHEN l > 0 THEN g / l ELSE 1e10 END', 'omega', 5)}, {_r('m * 252 / mdd', 'calmar', 5)}, {_r('mdd', 'max_drawdown', 5)} FROM a""")
def performance_metrics(spark, d):
    return _rounded(risk.performance_metrics(_returns(spark, d), "r", USER, BY_TIME), 5)


def _assets(spark, d):
    kinds = sorted(r["event_type"] for r in _events(spark, d).select("event_type").distinct().collect())  # a handful of event types
    day = F.col("ts").cast("date").alias("day")
    wide = _events(spark, d).groupBy(day).pivot("event_type", kinds).agg(F.avg("value") / 1000)
    return wide.dropna(), kinds


KINDS = ["click", "error", "purchase", "signup", "view"]


def _portfolio_sql() -> str:
    """a: means; k: the covariances' determinant and adjugate, in units of 1 / count; of the five event types' daily means."""
    det, adj = inverse(5, "s")
    wide = ", ".join(f"avg(CASE WHEN event_type = '{k}' THEN value END) / 1000 AS a{i}" for i, k in enumerate(KINDS))
    full = " AND ".join(f"a{i} IS NOT NULL" for i in range(5))
    cov = ", ".join(f"covar_samp(a{i}, a{j}) * 1e4 AS s{i}{j}" for i in range(5) for j in range(i, 5))
    cells = ", ".join(f"({adj[i, j]}) / ({det}) AS i{i}{j}" for i in range(5) for j in range(i, 5))
    return f"WITH d AS (SELECT ts::DATE AS day, {wide} FROM events GROUP BY 1), g AS (SELECT {cov}, {', '.join(f'avg(a{i}) AS m{i}' for i in range(5))} FROM d WHERE {full}), k AS (SELECT *, {cells} FROM g)"


def _weights_sql(goal: str) -> str:
    """Long-only weights, clipped and normalised, with the portfolio's return, volatility and ratio; goal: '1' or 'm<j>'."""
    cell = lambda i, j: f"i{min(i, j)}{max(i, j)}"
    raw = ", ".join("(" + " + ".join(f"{cell(i, j)} * {goal.replace('#', str(j))}" for j in range(5)) + f") AS u{i}" for i in range(5))
    total = " + ".join(f"u{i}" for i in range(5))
    norm = ", ".join(f"greatest(u{i} / ({total}), 0) AS p{i}" for i in range(5))
    again = ", ".join(f"p{i} / ({' + '.join(f'p{j}' for j in range(5))}) AS w{i}" for i in range(5))
    ret = " + ".join(f"w{i} * m{i}" for i in range(5))
    var = " + ".join(f"w{i} * w{j} * s{min(i, j)}{max(i, j)}" for i in range(5) for j in range(5))
    rows = " UNION ALL ".join(f"SELECT '{k}' AS asset, w{i} AS weight, ret, vol FROM z" for i, k in enumerate(KINDS))
    return f"{_portfolio_sql()}, u AS (SELECT *, {raw} FROM k), p AS (SELECT *, {norm} FROM u), w AS (SELECT *, {again} FROM p), z AS (SELECT *, {ret} AS ret, sqrt({var}) / 100 AS vol FROM w), r AS ({rows}) SELECT asset, round(weight, 5) AS weight, round(ret, 6) AS ret, round(vol, 6) AS volatility, round(ret / vol, 4) AS sharpe FROM r"


def _portfolio(df):
    return df.select("asset", F.round("weight", 5).alias("weight"), F.round("ret", 6).alias("ret"), F.round("volatility", 6).alias("volatility"), F.round("sharpe", 4).alias("sharpe"))


@register("minimum_variance_portfolio", _weights_sql("1.0"))
def minimum_variance_portfolio(spark, d):
    x, a = _assets(spark, d)
    return _portfolio(risk.minimum_variance_portfolio(x, a))


@register("max_sharpe_portfolio", _weights_sql("m#"))
def max_sharpe_portfolio(spark, d):
    x, a = _assets(spark, d)
    return _portfolio(risk.max_sharpe_portfolio(x, a))


def _frontier_sql(points: int = 20) -> str:
    cell = lambda i, j: f"i{min(i, j)}{max(i, j)}"
    pairs = [(i, j) for i in range(5) for j in range(5)]
    sums = f"{' + '.join(cell(i, j) for i, j in pairs)} AS a, {' + '.join(f'{cell(i, j)} * m{j}' for i, j in pairs)} AS b, {' + '.join(f'm{i} * {cell(i, j)} * m{j}' for i, j in pairs)} AS c, least(m0, m1, m2, m3, m4) AS lo, greatest(m0, m1, m2, m3, m4) AS hi"
    w = ", ".join("((" + " + ".join(f"{cell(i, j)} * (c - b * goal + m{j} * (a * goal - b))" for j in range(5)) + f") / (a * c - b * b)) AS w{i}" for i in range(5))
    ret = " + ".join(f"w{i} * m{i}" for i in range(5))
    var = " + ".join(f"w{i} * w{j} * s{min(i, j)}{max(i, j)}" for i, j in pairs)
    return f"{_portfolio_sql()}, f AS (SELECT *, {sums} FROM k), goals AS (SELECT f.*, p::INT AS point, lo + (hi - lo) * p / {points - 1}.0 AS goal FROM f, unnest(generate_series(0, {points - 1})) t(p)), w AS (SELECT *, {w} FROM goals) SELECT point, round(goal, 6) AS target, round({ret}, 6) AS ret, round(sqrt({var}) / 100, 6) AS volatility FROM w"


@register("efficient_frontier", _frontier_sql())
def efficient_frontier(spark, d):
    x, a = _assets(spark, d)
    return _rounded(risk.efficient_frontier(x, a, 20).select("point", "target", "ret", "volatility"))


COMPONENTS = [f"e{i}" for i in range(64)]


def _wide(spark, d):
    return read_table(spark, d, "embeddings").select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(COMPONENTS)])


@register("covariance_matrix", """WITH v AS (SELECT vec_id, unnest(generate_series(1, 64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), c AS (SELECT vec_id, i, x - avg(x) OVER (PARTITION BY i) AS x FROM v)
SELECT (a.i - 1)::INT AS i, (b.i - 1)::INT AS j, round(sum(a.x * b.x) / (count(*) - 1), 7) AS c FROM c a JOIN c b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY 1, 2""")
def covariance_matrix(spark, d):
    _, c, _ = linalg.covariance_matrix(_wide(spark, d), COMPONENTS)
    return _rounded(spark.createDataFrame([(i, j, float(c[i, j])) for i in range(len(c)) for j in range(i, len(c))], "i int, j int, c double"), 7)


@register("pca")
def pca(spark, d):
    return linalg.pca(_wide(spark, d), COMPONENTS, 3)[0]


@register("pca_scores")
def pca_scores(spark, d):
    return linalg.pca(_wide(spark, d), COMPONENTS, 3)[1]


@register("vector_primitives", "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings) SELECT vec_id, round(list_inner_product(e, e), 6) AS dot, round(sqrt(list_inner_product(e, e)), 6) AS norm, round(list_sum(e), 6) AS total, round(list_avg(e), 6) AS mean FROM v")
def vector_primitives(spark, d):
    e = F.col("embedding")
    return _rounded(read_table(spark, d, "embeddings").select("vec_id", vec.dot(e, e).alias("dot"), vec.norm(e).alias("norm"), vec.vector_sum(e).alias("total"), vec.vector_mean(e).alias("mean")))


@register("vector_algebra", """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), w AS (SELECT vec_id, e, list_transform(e, lambda x: 2 * x) AS t FROM v)
SELECT vec_id, round(list_inner_product(e, t), 6) AS doubled, round(list_sum(e) + list_sum(t), 5) AS added, round(list_sum(t) - list_sum(e), 5) AS taken, round(e[1] * t[64], 6) AS corner, round(list_inner_product(e, e) * 3, 5) AS applied FROM w""")
def vector_algebra(spark, d):
    e = F.transform("embedding", lambda x: x.cast("double"))
    x = read_table(spark, d, "embeddings").select("vec_id", e.alias("e")).withColumn("t", vec.scale(F.col("e"), 2.0))
    return x.select("vec_id", F.round(vec.dot(F.col("e"), F.col("t")), 6).alias("doubled"), F.round(vec.vector_sum(vec.add(F.col("e"), F.col("t"))), 5).alias("added"), F.round(vec.vector_sum(vec.subtract(F.col("t"), F.col("e"))), 5).alias("taken"),
                    F.round(vec.outer(F.col("e"), F.col("t"))[0][63], 6).alias("corner"), F.round(vec.vector_sum(vec.matvec(F.array(F.col("e"), F.col("t")), F.col("e"))), 5).alias("applied"))


@register("matmul", """WITH a AS (SELECT label AS i, unnest(generate_series(1, 64)) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings), s AS (SELECT i, k, sum(x) AS x FROM a GROUP BY 1, 2)
SELECT p.i::BIGINT AS i, q.i::BIGINT AS j, round(sum(p.x * q.x), 4) AS value FROM s p JOIN s q USING (k) GROUP BY 1, 2""")
def matmul(spark, d):
    """The sums of embeddings by label times their transpose."""
    x = read_table(spark, d, "embeddings").select(F.col("label").cast("long").alias("i"), F.posexplode("embedding").alias("j", "v")).groupBy("i", "j").agg(F.sum(F.col("v").cast("double")).alias("value"))
    return _rounded(vec.matmul(x, vec.transpose(x)), 4)


@register("singular_values")
def singular_values(spark, d):
    _, s, _ = linalg.tall_svd(_wide(spark, d).drop("vec_id"), COMPONENTS)
    return spark.createDataFrame([(i, float(x), float(s[0] / s[-1])) for i, x in enumerate(s)], "i int, value double, condition double")


@register("normal_log_likelihood", "SELECT event_type, round(sum(-0.5 * ln(2 * pi() * 2500) - (value - 100) * (value - 100) / 5000), 4) AS ll FROM events GROUP BY 1")
def normal_log_likelihood(spark, d):
    return _rounded(_events(spark, d).groupBy("event_type").agg(vec.normal_log_likelihood(F.col("value"), 100.0, 2500.0).alias("ll")), 4)


@register("bootstrap_mean")
def bootstrap_mean(spark, d):
    return sim.bootstrap_summary(sim.bootstrap_block_mean(_events(spark, d), "value", "event_id", 400, block=5))


@register("bootstrap_pairs")
def bootstrap_pairs(spark, d):
    return sim.bootstrap_summary(sim.bootstrap_lag_slope(_events(spark, d), "value", "event_id", 200))


@register("bootstrap_sums")
def bootstrap_sums(spark, d):
    return sim.bootstrap_sums(_events(spark, d), "value", 20, key=["event_id"])


def _normal(v):
    return -0.5 * float((((v - 3.0) / 2.0) ** 2).sum())


for _name in ("metropolis", "adaptive", "hmc", "slice"):

    def _chain(spark, d, name=_name):
        return sim.chain_summary(sim.sample_chains(spark, _normal, [0.0, 0.0], 400, 200, 2, name))

    register(f"mcmc_{_name}")(_chain)


def _draws(spark, d):
    """The events of five types as if they were draws of chains."""
    from .plans.frame import with_seq

    x = with_seq(_events(spark, d), ["event_type"], BY_TIME, "draw")
    return x.select(F.dense_rank().over(Window.orderBy("event_type")).cast("long").alias("chain"), "draw", F.lit(0).cast("long").alias("param"), "value")


@register("gelman_rubin", "WITH c AS (SELECT event_type, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY 1) SELECT 0::BIGINT AS param, count(*) AS chains, round(sqrt(((avg(n) - 1) / avg(n) * avg(v) + var_samp(m)) / avg(v)), 6) AS rhat FROM c")
def gelman_rubin(spark, d):
    return _rounded(sim.gelman_rubin(_draws(spark, d)).select("param", "chains", "rhat"))


@register("chain_diagnostics")
def chain_diagnostics(spark, d):
    return sim.chain_diagnostics(_draws(spark, d))


@register("waic", "WITH m AS (SELECT user_id AS obs, -value / 100 AS ll FROM events), g AS (SELECT obs, ln(avg(exp(ll))) AS lp, var_samp(ll) AS v FROM m GROUP BY 1) SELECT round(sum(lp), 5) AS lppd, round(sum(v), 5) AS p_waic, round(-2 * (sum(lp) - sum(v)), 5) AS waic FROM g")
def waic(spark, d):
    return _rounded(sim.waic(_events(spark, d).select(F.col("user_id").alias("obs"), (-F.col("value") / 100).alias("ll"))), 5)


@register("harmonic_marginal_likelihood", "WITH m AS (SELECT -value / 100 AS ll FROM events) SELECT round(ln(count(*)) - ln(sum(exp(-ll))), 6) AS log_ml FROM m")
def harmonic_marginal_likelihood(spark, d):
    return _rounded(sim.harmonic_marginal_likelihood(_events(spark, d).select((-F.col("value") / 100).alias("ll"))))


def _by_type(spark, d):
    """A series for each event type: few, as a chain takes a minute of work."""
    return rt.log_returns(_events(spark, d), "value", ["event_type"], BY_TIME).filter("r is not null")


@register("bayesian_garch")
def bayesian_garch(spark, d):
    return sim.bayesian_volatility(_by_type(spark, d), "r", KIND, BY_TIME, "garch", 200, 100).groupBy("event_type", "param").agg(F.avg("value").alias("mean"))


@register("bayesian_gjr_garch")
def bayesian_gjr_garch(spark, d):
    return sim.bayesian_volatility(_by_type(spark, d), "r", KIND, BY_TIME, "gjr", 200, 100).groupBy("event_type", "param").agg(F.avg("value").alias("mean"))


@register("bayesian_garch_dic")
def bayesian_garch_dic(spark, d):
    x = sim.bayesian_volatility(_by_type(spark, d), "r", KIND, BY_TIME, "garch", 200, 100)
    mean = x.groupBy("event_type").agg(F.avg("ll").alias("ll_mean"))
    return sim.dic(x, mean, KIND)


@register("mcmc_gibbs")
def mcmc_gibbs(spark, d):
    """A pair of normals of correlation one half, drawn in turn."""
    sd = 0.75**0.5
    blocks = [((0,), lambda x, q: [q.normal(0.5 * x[1], sd)]), ((1,), lambda x, q: [q.normal(0.5 * x[0], sd)])]
    return sim.chain_summary(sim.sample_chains(spark, None, [0.0, 0.0], 400, 200, 2, "gibbs", conditionals=blocks))


@register("mcmc_multi_chain_hmc")
def mcmc_multi_chain_hmc(spark, d):
    return sim.gelman_rubin(sim.sample_chains(spark, _normal, [0.0, 0.0], 400, 200, 4, "hmc"))


@register("garch_predictive")
def garch_predictive(spark, d):
    x = _by_type(spark, d)
    return sim.predictive(sim.bayesian_volatility(x, "r", KIND, BY_TIME, "garch", 200, 100), x, "r", KIND, BY_TIME, "garch", 5, 50)


@register("gjr_predictive")
def gjr_predictive(spark, d):
    x = _by_type(spark, d)
    return sim.predictive(sim.bayesian_volatility(x, "r", KIND, BY_TIME, "gjr", 200, 100), x, "r", KIND, BY_TIME, "gjr", 5, 50)


@register("windowed_realized", f"WITH {SERIES} SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS start, count(r) AS n_obs, round(sum(r * r), 6) AS rv FROM r0 GROUP BY 1, 2")
def windowed_realized(spark, d):
    from .streaming.realized_stream import windowed_realized as f

    return _rounded(f(_returns(spark, d), "ts", "r", USER).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n_obs", "rv"))
