"""Identities, exact recovery and known values."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions import dist
from marlstone.operators import diagnostics, glm, linalg, panel, realized, regression, returns, risk, simulation, tseries, vol


def lcg(seed, n):
    """Uniforms of a 64-bit linear congruential generator."""
    out = []
    for _ in range(n):
        seed = (seed * 6364136223846793005 + 1442695040888963407) % 2**64
        out.append((seed >> 33) / 2**31)
    return np.array(out)


def normals(seed, n):
    u = lcg(seed, 2 * n)
    return np.sqrt(-2 * np.log(np.maximum(u[::2], 1e-12))) * np.cos(2 * math.pi * u[1::2])


def frame(spark, **cols):
    n = len(next(iter(cols.values())))
    return spark.createDataFrame([(0, i, *[float(c[i]) for c in cols.values()]) for i in range(n)], ", ".join(["g long, seq0 long", *[f"{c} double" for c in cols]]))


def test_distributions():
    assert dist.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-12)
    assert dist.chi2_sf(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-12)
    assert dist.chi2_sf(2.0, 2) == pytest.approx(math.exp(-1), abs=1e-14)
    assert dist.f_sf(4.964602743730711, 1, 10) == pytest.approx(0.05, abs=1e-10)
    assert dist.beta_inc(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-12)
    assert dist.normal_quantile(0.05) == pytest.approx(-1.6448536269514722)


def test_returns_small(spark):
    df = frame(spark, p=[100, 110, 105, 115])
    r = [x["r"] for x in returns.log_returns(df, "p", ["g"], ["seq0"]).orderBy("seq").collect()]
    assert r == pytest.approx([math.log(1.1), math.log(105 / 110), math.log(115 / 105)], abs=1e-12)
    assert returns.log_returns(frame(spark, p=[0.0, 1.0, 2.0]), "p", ["g"], ["seq0"]).filter("r is null").count() == 1


def test_undifference_restores(spark):
    y = np.cumsum(np.cumsum(normals(3, 30)))
    d2 = returns.difference(frame(spark, y=y), "y", 2, ["g"], ["seq0"])
    back = returns.undifference(d2.select("g", "seq0", "dy"), "dy", [y[1], y[1] - y[0]], ["g"], ["seq0"], "z")
    assert [r["z"] for r in back.orderBy("seq0").collect()] == pytest.approx(list(y[2:]))


def test_semivariances_sum(spark):
    m = realized.realized_measures(frame(spark, r=normals(5, 50)), "r", ["g"], ["seq0"]).first()
    assert m["rsv_pos"] + m["rsv_neg"] == pytest.approx(m["rv"], rel=1e-14)


def test_event_window_pads(spark):
    r = frame(spark, r=np.arange(20) / 100).withColumnRenamed("seq0", "seq")
    ev = spark.createDataFrame([(0, 7, 1)], "g long, event_id long, seq long")
    w = {x["offset"]: x["ret"] for x in realized.event_windows(r, ev, "r", ["g"], 3, 3).collect()}
    assert w[-2] == 0.0 and w[-3] == 0.0 and w[0] == pytest.approx(0.01) and w[3] == pytest.approx(0.04)


def test_ols_recovers_a_line_and_matches_numpy(spark):
    x = np.arange(50.0)
    f = {r["term"]: r for r in regression.ols(frame(spark, y=1 + 2 * x, x=x), "y", ["x"]).collect()}
    assert f["const"]["beta"] == pytest.approx(1, abs=1e-9) and f["x"]["beta"] == pytest.approx(2, abs=1e-10) and f["x"]["r2"] == pytest.approx(1)
    n = 80
    a = np.column_stack([np.ones(n), normals(1, n), normals(2, n)])
    y = a @ [1, 2, -1] + normals(9, n)
    df = frame(spark, y=y, x1=a[:, 1], x2=a[:, 2])
    b = np.linalg.lstsq(a, y, rcond=None)[0]
    e, inv = y - a @ b, np.linalg.inv(a.T @ a)
    s = a * e[:, None]
    nw = s.T @ s
    for k in range(1, 5):
        c = s[k:].T @ s[:-k]
        nw = nw + (1 - k / 5) * (c + c.T)
    for cov, v in (("classical", inv * (e @ e) / (n - 3)), ("white", inv @ (s.T @ s) @ inv), ("newey_west", inv @ nw @ inv)):
        rows = regression.ols(df, "y", ["x1", "x2"], cov=cov, order=["seq0"], max_lag=4).collect()
        assert [r["beta"] for r in rows] == pytest.approx(list(b), rel=1e-9)
        assert [r["se"] for r in rows] == pytest.approx(list(np.sqrt(np.diag(v))), rel=1e-8)


def test_singular_and_short_groups_have_a_status(spark):
    x = np.arange(10.0)
    assert {r["status"] for r in regression.ols(frame(spark, y=x, x=x * 0 + 1), "y", ["x"]).collect()} == {"singular"}
    assert {r["status"] for r in regression.ols(frame(spark, y=x[:2], x=x[:2]), "y", ["x"]).collect()} == {"too few rows"}


def test_gls_with_identity_is_ols():
    x = np.column_stack([np.ones(30), normals(4, 30)])
    y = x @ [1, 2] + normals(6, 30)
    assert regression.gls(y, x, np.eye(30))["beta"] == pytest.approx(np.linalg.lstsq(x, y, rcond=None)[0])


def test_fixed_effects_and_fama_macbeth(spark):
    rows, u = [], lcg(42, 150)
    for e, a in enumerate((1.0, -0.5, 0.3)):
        for t in range(50):
            x = float(u[e * 50 + t])
            rows.append((e, t, a + 2.5 * x, x))
    df = spark.createDataFrame(rows, "e long, t long, y double, x double")
    for effects in ("entity", "twoway"):
        assert panel.fixed_effects(df, "y", ["x"], "e", "t", effects, rounds=5).first()["beta"] == pytest.approx(2.5, abs=1e-8)
    g = spark.createDataFrame([(t, 1.0 + 2 * i, float(i)) for t in range(5) for i in range(6)], "t long, y double, x double")
    assert [r["gamma"] for r in panel.fama_macbeth(g, "y", ["x"], "t", intercept=True).collect()] == pytest.approx([1, 2])


def test_logit_score_is_zero(spark):
    x = normals(8, 300)
    y = (lcg(2, 300) < 1 / (1 + np.exp(-(0.5 + x)))).astype(float)
    for link in ("logit", "probit"):
        r = glm.binary_model(frame(spark, y=y, x=x), "y", ["x"], link).collect()
        assert r[0]["converged"] and r[0]["ll"] > r[0]["ll_null"]
        if link == "logit":
            p = 1 / (1 + np.exp(-(r[0]["beta"] + r[1]["beta"] * x)))
            assert abs((y - p).sum()) < 1e-5 and abs(((y - p) * x).sum()) < 1e-5


def test_iv_without_endogeneity_is_ols(spark):
    z = normals(1, 100)
    df = frame(spark, y=3 + 2 * z + normals(2, 100) * 0.1, x=z, z=z)
    a = regression.iv_2sls(df, "y", ["x"], ["z"]).collect()
    b = regression.ols(df, "y", ["x"]).collect()
    assert [r["beta"] for r in a] == pytest.approx([r["beta"] for r in b])


def test_var_irf_fevd_granger(spark):
    e1, e2 = normals(1, 300), normals(2, 300)
    y = np.zeros((300, 2))
    for t in range(1, 300):
        y[t] = [0.5 * y[t - 1, 0] + 0.4 * y[t - 1, 1] + e1[t], 0.3 * y[t - 1, 1] + e2[t]]
    df = frame(spark, a=y[:, 0], b=y[:, 1])
    fit = tseries.var(df, ["a", "b"], 1, ["seq0"], ["g"])
    x = np.column_stack([np.ones(299), y[:-1]])
    assert fit["coefficients"] == pytest.approx(np.linalg.lstsq(x, y[1:], rcond=None)[0].T)
    shares = tseries.var_fevd(spark, fit, 8).groupBy("h", "response").agg(F.sum("share").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1) for r in shares)
    assert tseries.granger_causality(df, "a", "b", 1, ["g"], ["seq0"]).first()["p"] < 1e-6


def test_arima_finds_its_parts():
    e = normals(7, 1200)
    y = np.zeros(1200)
    for t in range(1, 1200):
        y[t] = 0.6 * y[t - 1] + e[t] + 0.4 * e[t - 1]
    f = tseries.fit_arima(y, 1, 0, 1)
    assert f["beta"][1] == pytest.approx(0.6, abs=0.1) and f["beta"][2] == pytest.approx(0.4, abs=0.1)
    level, lo, hi = tseries.forecast_arima(np.cumsum(y), tseries.fit_arima(np.cumsum(y), 1, 1, 1), 1, 1, 1, 5)
    assert (lo < level).all() and (level < hi).all() and np.diff(hi - lo).min() > 0


def test_arima_recursion_by_blocks():
    z = normals(8, 700)
    for p, m in ((0, [0.5]), (1, [-0.9]), (2, [0.3, -0.4]), (1, [0.2, 0.1, 0.4]), (1, [])):
        beta, q = np.array([0.1, *[0.2] * p, *m]), len(m)
        e = np.zeros(len(z))
        for t in range(p, len(z)):
            e[t] = z[t] - 0.1 - sum(0.2 * z[t - 1 - j] for j in range(p)) - sum(m[j] * e[t - 1 - j] for j in range(min(q, t)))
        got = tseries._css(beta, z, p, q)
        assert got == pytest.approx(e, abs=1e-12)
        apart = np.column_stack([(tseries._css(beta + h, z, p, q) - tseries._css(beta - h, z, p, q)) / 2e-6 for h in np.eye(len(beta)) * 1e-6])
        assert tseries._css_slopes(got, beta, z, p, q) == pytest.approx(apart[p:], abs=1e-6)


def test_arima_over_a_long_series():
    e = normals(9, 150_000)
    y = 1.0 + e + 0.4 * np.concatenate(([0.0], e[:-1]))
    start = time.perf_counter()
    f = tseries.fit_arima(y, 0, 0, 1)
    assert time.perf_counter() - start < 5  # a loop over rows takes several times as long
    assert f["beta"] == pytest.approx([1.0, 0.4], abs=0.02) and f["n"] == len(y)
    x = np.column_stack([np.ones(len(y) - 3), y[2:-1], y[1:-2], y[:-3]])
    assert tseries._long_residuals(y, 3)[3:] == pytest.approx(y[3:] - x @ np.linalg.lstsq(x, y[3:], rcond=None)[0], abs=1e-9)


def test_arima_111_is_of_differences(spark):
    from marlstone import catalog

    sf = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{sf}/events.parquet").orderBy("ts", "event_id").toPandas()
    got = {r["event_type"]: r for r in catalog.queries()["arima_111"](spark, sf).collect()}
    assert set(got) == set(events["event_type"])
    for kind, rows in events.groupby("event_type"):
        y = rows["value"].to_numpy(float)
        r, want = got[kind], tseries.fit_arima(y[1:] - y[:-1], 1, 0, 1)
        assert r["n"] == len(y) - 2 and r["status"] == "ok"  # a row is the first difference's, one the lag's
        assert [r["const"], *r["ar"], *r["ma"]] == pytest.approx(list(want["beta"]), abs=1e-9) and r["sigma2"] == pytest.approx(want["sigma2"])


@pytest.mark.parametrize("seed", (28, 29, 30, 32, 35, 121))
def test_arima_of_noise_differenced_once_too_often(seed):
    """Noise's differences have a moving average at -1, and by zeros before the start conditional squares fall on beyond it."""
    y = 50 + normals(seed, 200)
    f = tseries.fit_arima(y, 1, 1, 1)
    z, least = np.diff(y), math.inf
    for m in np.linspace(-1, 1, 201):
        x = np.zeros((len(z), 3))  # what the recursion makes of the constant, the lag and the series
        for t in range(1, len(z)):
            x[t] = [1.0, z[t - 1], z[t]] - m * x[t - 1]
        b = np.linalg.lstsq(x[:, :2], x[:, 2], rcond=None)[0]
        least = min(least, float(((x[:, 2] - x[:, :2] @ b) ** 2).sum()))
    assert f["status"] == "ok" and abs(f["beta"][2]) <= 1
    assert float((f["resid"] ** 2).sum()) <= least * (1 + 1e-9)


def test_arima_partials_and_back():
    for r in ([0.5], [0.3, -0.7], [-0.9, 0.2, 0.6]):
        m = tseries._averages(np.array(r))
        assert abs(np.roots([1.0, *m])).max() < 1 and tseries._partials(m) == pytest.approx(r)
    assert tseries._partials(np.array([2.0])) == pytest.approx([0.5])


def test_garch_fit_and_fold(spark):
    z, h, r = normals(11, 1500), 1.0, []
    for t in range(1500):
        r.append(math.sqrt(h) * z[t])
        h = 0.05 + 0.1 * r[-1] ** 2 + 0.85 * h
    f = vol.fit_volatility("garch", np.array(r))
    assert 0.8 < f["persistence"] < 1 and f["params"]["alpha"] == pytest.approx(0.1, abs=0.06)
    for kind in ("gjr", "egarch", "garch_t"):
        assert vol.fit_volatility(kind, np.array(r[:400]))["ll"] > vol.BAD
    assert vol.fit_volatility("garch", np.ones(5))["status"] == "too few rows"
    df = frame(spark, r=r[:60])
    got = vol.garch_likelihood_grid(df, "r", ["g"], ["seq0"], [(0.05, 0.1, 0.8)]).first()["ll"]
    assert got == pytest.approx(vol.log_likelihood("garch", (0.05, 0.1, 0.8), np.array(r[:60]) - np.mean(r[:60])))


def test_diagnostics(spark):
    x = normals(21, 200)
    df = frame(spark, x=x, e=x)
    assert diagnostics.jarque_bera(df, "x").first()["p"] > 0.01
    assert diagnostics.durbin_watson(df, "x", ["g"], ["seq0"]).first()["statistic"] == pytest.approx(((np.diff(x)) ** 2).sum() / (x**2).sum())
    walk = frame(spark, x=np.cumsum(x))
    assert not diagnostics.adf_test(walk, "x", ["g"], ["seq0"], 1).first()["stationary"]
    assert diagnostics.adf_test(df, "x", ["g"], ["seq0"], 1).first()["stationary"]
    assert diagnostics.kpss_test(walk, "x", ["g"], ["seq0"]).first()["statistic"] > diagnostics.kpss_test(df, "x", ["g"], ["seq0"]).first()["statistic"]
    assert diagnostics.white_test(frame(spark, e=x, a=normals(1, 200)), "e", ["a"]).first()["df"] == 2


def test_risk(spark):
    x = normals(31, 300) * 0.01
    df = frame(spark, r=x)
    h = risk.value_at_risk(df, "r", ["g"]).first()
    k = math.floor((1 - 0.95) * 300)
    assert h["var"] == pytest.approx(-np.sort(x)[k]) and h["cvar"] == pytest.approx(-np.sort(x)[: k + 1].mean())
    c = np.cumsum(x)
    d = risk.drawdown_analysis(df, "r", ["g"], ["seq0"]).first()
    assert d["max_drawdown"] == pytest.approx((np.maximum.accumulate(c) - c).max()) and d["trough"] - d["peak"] == d["duration"]
    a = frame(spark, a=x, b=normals(5, 300) * 0.02 + 0.001, c=normals(6, 300) * 0.03 + 0.002)
    for p in (risk.minimum_variance_portfolio(a, ["a", "b", "c"]), risk.max_sharpe_portfolio(a, ["a", "b", "c"])):
        assert sum(r["weight"] for r in p.collect()) == pytest.approx(1)
    assert risk.efficient_frontier(a, ["a", "b", "c"], 7).count() == 7


def test_linalg(spark):
    m = np.column_stack([normals(k, 60) for k in range(4)])
    df = frame(spark, **{f"x{i}": m[:, i] for i in range(4)})
    comp, scores = linalg.pca(df, [f"x{i}" for i in range(4)])
    val = np.sort(np.linalg.eigvalsh(np.cov(m.T)))[::-1]
    assert [r["variance"] for r in comp.filter("variable = 'x0'").orderBy("component").collect()] == pytest.approx(list(val))
    assert scores.agg(F.var_samp("score1")).first()[0] == pytest.approx(val[0])
    assert linalg.tall_svd(df, [f"x{i}" for i in range(4)])[1] == pytest.approx(np.linalg.svd(m, compute_uv=False))
    with pytest.raises(np.linalg.LinAlgError):
        linalg.cholesky(np.array([[1.0, 2], [2, 1]]))


def test_chains_find_the_target(spark):
    logp = lambda v: -0.5 * float((((v - 3) / 2) ** 2).sum())
    for s in ("metropolis", "adaptive", "hmc", "slice"):
        d = simulation.sample_chains(spark, logp, [0.0], 1500, 500, 2, s)
        r = simulation.chain_summary(d).first()
        assert abs(r["mean"] - 3) < 0.7 and 1.2 < r["sd"] < 3
    g = simulation.gibbs(None, [0, 0], 2000, 100, np.random.default_rng(1), [((0,), lambda x, q: q.normal(0.5 * x[1], 0.8)), ((1,), lambda x, q: q.normal(0.5 * x[0], 0.8))])[0]
    assert abs(g.mean()) < 0.2
    e = simulation.effective_sample_size(d).first()["ess"]
    assert 0 < e <= 1500.0001


def test_rolling_multiplicative_garch_windows_leave_no_row_out(spark):
    from marlstone import catalog

    got = catalog.queries()["rolling_multiplicative_garch"](spark, "/root/testdata/sf0.01").groupBy("event_type").agg(F.max("win").alias("last"), F.countDistinct("win").alias("n")).collect()
    full = {r["event_type"]: r["n"] for r in returns.log_returns(spark.read.parquet("/root/testdata/sf0.01/events.parquet"), "value", ["user_id"], ["ts", "event_id"]).filter("r is not null").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {r["event_type"] for r in got} == set(full)
    for r in got:  # windows of 252 at steps of 21 overlap; rows after the last whole step aside, each is in one
        assert r["last"] == (full[r["event_type"]] - 252) // 21 and r["n"] == r["last"] + 1


def test_bootstrap_takes_the_whole_table(spark):
    v = np.concatenate((normals(3, 500), normals(4, 2500) + 7))
    df = frame(spark, i=np.arange(3000) * 3 + 1, v=v).repartition(5)
    x = sorted(simulation._places(df, "v", "i").collect(), key=lambda r: r["__p"])
    assert [r["__p"] for r in x] == list(range(3000)) and np.allclose([r["__v"] for r in x], v) and x[0]["__q"] is None and np.allclose([r["__q"] for r in x[1:]], v[:-1])
    b = simulation.bootstrap_summary(simulation.bootstrap_block_mean(df, "v", "i", 100, block=5)).first()
    blocks = np.array([np.roll(v, -k)[:5].mean() for k in range(3000)])
    assert b["n"] == 100 and abs(b["mean"] - v.mean()) < 0.1 and 0.5 < b["se"] / (blocks.std() / np.sqrt(600)) < 1.5
    p = simulation.bootstrap_summary(simulation.bootstrap_lag_slope(df, "v", "i", 50)).first()
    assert abs(p["mean"] - np.polyfit(v[:-1], v[1:], 1)[0]) < 0.02


def test_bootstrap_queries_see_every_event(spark):
    from marlstone import catalog

    df = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    mean = df.agg({"value": "avg"}).first()[0]
    got = catalog.queries()["bootstrap_mean"](spark, "/root/testdata/sf0.01").first()
    assert got["lower"] < mean < got["upper"] and got["se"] < df.selectExpr("stddev(value)").first()[0] / np.sqrt(df.count()) * 1.5


def test_bootstrap(spark):
    b = simulation.bootstrap_summary(simulation.bootstrap_draws(spark, normals(2, 100) + 5, np.mean, 300)).first()
    assert b["n"] == 300 and 4.5 < b["mean"] < 5.5 and b["lower"] < b["mean"] < b["upper"] and b["p"] == 0
    s = simulation.bootstrap_sums(frame(spark, v=normals(2, 400) + 5), "v", 20)
    assert s.agg(F.avg("mean")).first()[0] == pytest.approx(5, abs=0.3)


def test_streaming_windows(spark, tmp_path):
    from marlstone.streaming.realized_stream import windowed_realized

    rows = [(f"2024-01-0{1 + i // 4} 0{i % 4}:00:00", 0.1 * i, "a") for i in range(8)]
    spark.createDataFrame(rows, "ts string, r double, k string").write.parquet(str(tmp_path / "in"))
    st = spark.readStream.schema("ts string, r double, k string").parquet(str(tmp_path / "in"))
    q = windowed_realized(st.withColumn("ts", F.to_timestamp("ts")), "ts", "r", ["k"]).writeStream.outputMode("complete").format("memory").queryName("rv").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("rv").agg(F.sum("n_obs")).first()[0] == 8


def test_priors_at_fixed_points():
    ln = math.log
    assert simulation.garch_log_prior([2e-5, 0.1, 0.8]) == pytest.approx(ln(2e-5) - 2 + ln(0.2) + 9 * ln(0.8) + 7 * ln(0.8) + ln(0.2))
    assert simulation.garch_log_prior([2.0, 0.1, 0.8], simulation.GARCH_PRIOR | {"omega_rate": 1.0}) == pytest.approx(ln(2.0) - 2 + ln(0.2) + 9 * ln(0.8) + 7 * ln(0.8) + ln(0.2))
    for bad in ([0, 0.1, 0.8], [1e-5, 0.5, 0.4], [1e-5, 0.1, 0.95], [1e-5, 0.0, 0.5]):
        assert simulation.garch_log_prior(bad) == -math.inf
    p = [1e-5, 0.05, 0.04, 0.9]
    at = -1 - 2 * ln(1.5) - 2 * ln(1.4) + 7 * ln(0.9) + ln(0.1)
    assert simulation.gjr_log_prior([*p, 8.0], None) == pytest.approx(at - 1.5 * ln(8)) and simulation.gjr_log_prior(p, 8.0) == pytest.approx(at)
    for bad in ([1e-5, 0.05, -0.01, 0.9, 8], [1e-5, 0.05, 0.04, 0.9, 2.0], [1e-5, 0.05, 0.04, 0.9, 201], [1e-5, 0.1, 0.1, 0.9, 8]):
        assert simulation.gjr_log_prior(bad, None) == -math.inf


def test_bayesian_garch_follows_its_prior(spark):
    r = normals(3, 400) * 0.01
    df = frame(spark, r=r, k=[1.0] * 400)
    loose = {"omega_rate": 1e4}
    d = simulation.bayesian_volatility(df, "r", ["k"], ["seq0"], "garch", 600, 600, prior=loose)
    m = {x["param"]: x["m"] for x in d.groupBy("param").agg(F.avg("value").alias("m")).collect()}
    assert 0 < m["alpha"] < 0.5 and m["omega"] > 0 and m["alpha"] + m["beta"] < 1
    assert d.filter("param = 'alpha' and (value <= 0 or value >= 0.5)").count() == 0
    g = simulation.bayesian_volatility(df, "r", ["k"], ["seq0"], "gjr", 200, 200)
    assert g.filter("(param = 'gamma' and value < 0) or (param = 'nu' and (value <= 2 or value > 200))").count() == 0


def test_effective_size():
    assert simulation.effective_size(np.array([1.0, 2.0, 3.0])) == 3 and simulation.effective_size(np.ones(50)) == 50
    x = np.repeat(np.random.default_rng(1).normal(size=40), 100)  # correlated over 100 draws
    want, v, y = 0.0, float(((x - x.mean()) ** 2).mean()), x - x.mean()
    for k in range(1, 2000):
        r = float((y[k:] * y[:-k]).sum()) / len(x) / v
        if r < 0.05:
            break
        want += r
    assert simulation.effective_size(x) == pytest.approx(len(x) / (1 + 2 * want))
    assert simulation.effective_size(np.arange(5000.0)) >= 1  # lags beyond 1000 count


def test_gibbs_on_spark(spark):
    blocks = [((0,), lambda x, q: [q.normal(0.5 * x[1], 0.75**0.5)]), ((1,), lambda x, q: [q.normal(0.5 * x[0], 0.75**0.5)])]
    logp = lambda v: -float(v[0] ** 2 - v[0] * v[1] + v[1] ** 2) / 1.5
    d = simulation.sample_chains(spark, logp, [0.0, 0.0], 1500, 100, 2, "gibbs", density=True, conditionals=blocks)
    w = d.groupBy("chain", "draw").pivot("param", [0, 1]).agg(F.first("value")).join(d.select("chain", "draw", "lp").distinct(), ["chain", "draw"]).toPandas()
    assert np.corrcoef(w["0"], w["1"])[0, 1] == pytest.approx(0.5, abs=0.06) and len(w) == 3000
    assert [logp((a, b)) for a, b in zip(w["0"], w["1"])] == pytest.approx(list(w["lp"]))
    assert simulation.gelman_rubin(d.drop("lp")).filter("not converged").count() == 0
    with pytest.raises(ValueError):
        simulation.sample_chains(spark, None, [0.0], 10, 10, 1, "metropolis")


def test_iv_newey_west(spark):
    rng = np.random.default_rng(5)
    n, lag = 300, 4
    z, u = rng.normal(size=n), np.zeros(n)
    for t in range(1, n):
        u[t] = 0.6 * u[t - 1] + rng.normal()
    x = z + 0.5 * u + rng.normal(size=n)
    y = 1 + 2 * x + u
    df = frame(spark, y=y, x=x, z=z)
    got = {r["term"]: r for r in regression.iv_2sls(df, "y", ["x"], ["z"], cov="newey_west", order=["seq0"], max_lag=lag).collect()}
    Z, X = np.column_stack([np.ones(n), z]), np.column_stack([np.ones(n), x])
    H = Z @ np.linalg.solve(Z.T @ Z, Z.T @ X)
    b = np.linalg.solve(H.T @ X, H.T @ y)
    s = H * (y - X @ b)[:, None]
    m = s.T @ s
    for k in range(1, lag + 1):
        g = s[k:].T @ s[:-k]
        m += (1 - k / (lag + 1)) * (g + g.T)
    inv = np.linalg.inv(H.T @ H)
    v = inv @ m @ inv
    for i, t in enumerate(("const", "x")):
        assert got[t]["beta"] == pytest.approx(b[i]) and got[t]["se"] == pytest.approx(math.sqrt(v[i, i]))
    with pytest.raises(ValueError):
        regression.iv_2sls(df, "y", ["x"], ["z"], cov="other")


def test_fits_side_by_side_are_those_of_plain_recursions(spark):
    """Variances step by step in time, and each series fitted alone, as against all at once."""
    rng = np.random.default_rng(9)
    series = [rng.normal(size=n) * s for n, s in ((12, 1), (40, 2), (90, 0.1), (8, 1), (60, 1), (61, 5), (62, 1), (63, 1), (64, 1))] + [np.ones(20)]
    at = {"garch": [0.1, 0.1, 0.8], "gjr": [0.1, 0.05, 0.1, 0.8], "egarch": [0.01, 0.1, -0.05, 0.9], "garch_t": [0.1, 0.1, 0.8, 6.0]}
    for kind, p in at.items():
        e = series[2] - series[2].mean()
        h = [p[0] / (1 - p[1] - p[2]) if kind == "garch" else (e**2).mean()]
        for x in e[:-1]:
            if kind == "egarch":
                z = x / math.sqrt(h[-1])
                h.append(math.exp(p[0] + p[1] * abs(z) + p[2] * z + p[3] * math.log(h[-1])))
            else:
                h.append(p[0] + (p[1] + (p[2] * (x < 0) if kind == "gjr" else 0)) * x * x + p[3 if kind == "gjr" else 2] * h[-1])
        h = np.array(h)
        ll = -0.5 * (np.log(2 * math.pi * h) + e * e / h)
        if kind == "garch_t":
            ll = np.array([dist.student_t_logpdf(v / math.sqrt(k * 4 / 6), 6.0) - 0.5 * math.log(k * 4 / 6) for v, k in zip(e, h)])
        assert vol.log_likelihood(kind, p, e) == pytest.approx(ll.sum())
        for one, f in zip((vol.fit_volatility(kind, r) for r in series), vol.fit_many(kind, series)):
            assert one["status"] == f["status"]
            if f["status"] == "ok":
                assert one["ll"] == pytest.approx(f["ll"], abs=1e-6) and len(f["h"]) == f["n"]
    assert [f["status"] for f in vol.fit_many("garch", series)][3:10:6] == ["too few rows", "constant"]
    df = spark.createDataFrame([(k if k else None, i, float(x)) for k, r in enumerate(series) for i, x in enumerate(r)], "k int, i int, r double").repartition(3)
    got = {r["k"]: r for r in vol.volatility_model(df, "r", ["k"], ["i"]).collect()}
    assert len(got) == 10 and got[2]["ll"] == pytest.approx(vol.fit_volatility("garch", series[2])["ll"]) and got[3]["status"] == "too few rows" and got[None]["n"] == 12


def test_windows_of_the_component_model(spark):
    r = normals(4, 130) * 0.01
    df = frame(spark, r=r, rv=r * r)
    got = {x["win"]: x["volatility"] for x in vol.rolling_multiplicative_garch(df, "r", "rv", ["g"], ["seq0"], 60, 21).collect()}
    assert sorted(got) == [0, 1, 2, 3]
    for k, v in got.items():
        assert v == pytest.approx(math.sqrt(vol.component_volatility(r[21 * k : 21 * k + 60], (r * r)[21 * k : 21 * k + 60])[2][-1] * 252), rel=1e-4)


def test_two_way_effects_of_an_unbalanced_panel(spark, monkeypatch):
    rng = np.random.default_rng(11)
    rows = [(int(e), int(t), float(rng.normal()), float(rng.normal())) for e in range(30) for t in rng.choice(12, rng.integers(2, 9))]
    rows = [(e, t, 2.0 * x + 0.1 * y + 0.3 * e - 0.2 * t * t, x) for e, t, y, x in rows]
    df = spark.createDataFrame(rows, "e long, t long, y double, x double")
    d = np.column_stack([np.equal.outer([r[0] for r in rows], range(30)), np.equal.outer([r[1] for r in rows], range(1, 12)), [r[3] for r in rows]]).astype(float)
    want = np.linalg.lstsq(d, np.array([r[2] for r in rows]), rcond=None)[0][-1]
    exact = panel.fixed_effects(df, "y", ["x"], "e", "t", effects="twoway", cov="classical").first()
    assert exact["beta"] == pytest.approx(want, abs=1e-9)
    monkeypatch.setattr(panel, "SOLVED", 3)
    assert panel.fixed_effects(df, "y", ["x"], "e", "t", effects="twoway", cov="classical", rounds=30).first()["beta"] == pytest.approx(want, abs=1e-6)
    with pytest.raises(RuntimeError):
        panel.fixed_effects(df, "y", ["x"], "e", "t", effects="twoway", cov="classical", rounds=1).first()


def test_long_form_matrices(spark):
    from marlstone.functions import vectors as vec

    a = np.arange(6.0).reshape(2, 3)
    long = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(2) for j in range(3)], "i long, j long, value double")

    def dense(df, n, m):
        out = np.zeros((n, m))
        for r in df.collect():
            out[r["i"], r["j"]] = r["value"]
        return out

    assert (dense(vec.matmul(long, vec.transpose(long)), 2, 2) == a @ a.T).all()
    assert (dense(vec.matmul(long, vec.identity(spark, 3)), 2, 3) == a).all() and dense(vec.filled(spark, 2, 2, 1.0), 2, 2).sum() == 4
    assert sorted(map(tuple, vec.column(long, 1).collect())) == [(0, 1.0), (1, 4.0)]
    new = vec.with_column(long, 1, spark.createDataFrame([(0, 9.0), (1, 8.0)], "i long, value double"))
    assert (dense(new, 2, 3) == np.array([[0, 9, 2], [3, 8, 5.0]])).all()


def test_summaries(spark):
    df = frame(spark, y=[1.0, 2.1, 2.9, 4.2, 5.0, 6.1], x=[1.0, 2, 3, 4, 5, 6], e=[0.0, 0, 0, 1, 1, 1])
    text = regression.summary(regression.ols(df, "y", ["x"]).collect())
    assert text.startswith("OLS\nn = 6   r2 = 0.99") and "const" in text and len(text.split("\n")) == 6
    text = panel.summary(df, panel.fixed_effects(df, "y", ["x"], "e", "seq0", cov="classical").collect(), "e", "seq0")
    assert "Fixed effects (entity)" in text and "entities = 2   periods = 6   rows_an_entity = 3" in text


def test_linear_algebra(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 4))
    spd = x.T @ x
    assert linalg.cholesky(spd) == pytest.approx(np.linalg.cholesky(spd)) and linalg.invert_spd(spd) @ spd == pytest.approx(np.eye(4), abs=1e-9)
    b = rng.normal(size=40)
    assert linalg.solve_least_squares(x, b) == pytest.approx(np.linalg.lstsq(x, b, rcond=None)[0]) and linalg.solve_spd(spd, x.T @ b) == pytest.approx(np.linalg.solve(spd, x.T @ b))
    s = np.linalg.svd(x, compute_uv=False)
    assert linalg.condition_number(x) == pytest.approx(s[0] / s[-1]) and linalg.svd(x)[1] == pytest.approx(s)
    assert linalg.eigen_symmetric(spd)[0] == pytest.approx(np.sort(s**2))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "k long, a double, b double, c double, d double")
    for wide in (16, 2):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(linalg, "WIDE", wide)
            u, got, vt = linalg.tall_svd(df, list("abcd"))
            assert got == pytest.approx(s)
            w = np.array([[r[f"u{j + 1}"] for j in range(4)] for r in u.orderBy("k").collect()])
            assert w @ np.diag(got) @ vt == pytest.approx(x)
            mean, cov, n = linalg.covariance_matrix(df, list("abcd"))
            assert cov == pytest.approx(np.cov(x.T)) and mean == pytest.approx(x.mean(0)) and n == 40
    comp, scores = linalg.pca(df, list("abcd"), 2)
    val = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert sorted({r["variance"] for r in comp.collect()}, reverse=True) == pytest.approx(list(val[:2]))
    assert scores.agg(F.var_samp("score1")).first()[0] == pytest.approx(val[0])


def test_dic_and_rolling_callbacks(spark):
    d = spark.createDataFrame([("a", 0, k, -10.0 - k) for k in range(3)], "g string, chain long, draw long, ll double")
    at = spark.createDataFrame([("a", -10.5)], "g string, ll_mean double")
    assert simulation.dic(d, at, ["g"]).first()["dic"] == pytest.approx(2 * (2 * 11) + 2 * -10.5)
    df = frame(spark, v=[3.0, 1, 4, 1, 5, 9, 2, 6])
    got = [(r["seq"], r["value_applied"]) for r in returns.rolling_apply(df, "v", 3, lambda s: float(s.max() - s.min()), ["g"], ["seq0"]).orderBy("seq").collect()]
    assert got == [(2, 3.0), (3, 3.0), (4, 4.0), (5, 8.0), (6, 7.0), (7, 7.0)]
    got = [r["value_applied"] for r in returns.expanding_apply(df, "v", 6, lambda s: float(len(s)), ["g"], ["seq0"]).orderBy("seq").collect()]
    assert got == [6.0, 7.0, 8.0] and returns.rolling_apply(df, "v", 30, lambda s: 0.0, ["g"], ["seq0"]).count() == 0
