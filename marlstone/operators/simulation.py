"""Bootstrap, Markov chain samplers, chain diagnostics and predictive simulation. Draws match in distribution, by seed."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dist import student_t_logpdf
from ..plans.frame import with_seq
from .vol import _variance, fit_volatility, log_likelihood


#: The default priors of the Bayesian volatility models.
GARCH_PRIOR = {"omega_shape": 2.0, "omega_rate": 1e5, "alpha_a": 2.0, "alpha_b": 10.0, "beta_a": 8.0, "beta_b": 2.0}
GJR_PRIOR = {"omega_rate": 1e5, "alpha_power": 2.0, "alpha_scale": 10.0, "gamma_power": 2.0, "gamma_scale": 10.0, "beta_a": 8.0, "beta_b": 2.0, "nu_power": 1.5, "nu_most": 200.0}
#: The samplers' tuning. Random walk: draws between adaptations, growth, shrinkage, wanted acceptance.
WALK_EVERY, WALK_UP, WALK_DOWN, WALK_GOAL = 100, 1.1, 0.9, 0.234
#: Adaptive walk: scale of the covariance, draws before the first and between adaptations, ridge.
ADAPT_SCALE, ADAPT_FROM, ADAPT_EVERY, ADAPT_RIDGE = 2.38**2, 100, 50, 1e-10
#: Dual averaging: shrinkage, offset, power. Slices: steps out, shrinks. Autocorrelation below which a chain counts as mixed.
DUAL_SHRINK, DUAL_OFFSET, DUAL_POWER, STEPS_OUT, SHRINKS, MIXED = 0.05, 10, 0.75, 32, 200, 0.05


def block_indices(n: int, block: int, rng: np.random.Generator, circular: bool = True) -> np.ndarray:
    """n positions: single ones for block <= 1, else blocks from random starts, around the end or within the data."""
    if block <= 1:
        return rng.integers(0, n, n)
    k = -(-n // block)
    starts = rng.integers(0, n if circular else max(1, n - block + 1), k)
    return ((starts[:, None] + np.arange(block)) % n).ravel()[:n]


def bootstrap_draws(spark: SparkSession, data: np.ndarray, statistic: Callable[[np.ndarray], float], replicates: int = 1000, seed: int = 42, method: str = "iid", block: int = 1) -> DataFrame:
    """(rep, value): the statistic of resampled rows of data (1-D, or rows of y and x together). Replicates spread over tasks;
    the data are broadcast and must be small. method: iid, block (moving) or circular."""
    if data.nbytes > 64 << 20:
        raise ValueError("data of over 64 MB aren't broadcast; use bootstrap_sums")
    shared = spark.sparkContext.broadcast(np.asarray(data, float))
    b = 1 if method == "iid" else block

    def run(batches):
        x = shared.value
        for pdf in batches:
            rows = [(int(i), float(statistic(x[block_indices(len(x), b, np.random.Generator(np.random.PCG64([seed, int(i)])), method != "block")]))) for i in pdf["id"]]
            yield pd.DataFrame(rows, columns=["rep", "value"])

    return spark.range(replicates).mapInPandas(run, "rep long, value double")


bootstrap_pairs = bootstrap_draws


def _poisson(mean: float, *key) -> Column:
    """A Poisson draw that a hash of the key decides."""
    acc, below = 0.0, []
    for k in range(8):
        acc += math.exp(-mean) * mean**k / math.factorial(k)
        below.append(acc)
    u = F.pmod(F.xxhash64(*key), F.lit(1 << 40)) / float(1 << 40)
    return sum((u > c).cast("int") for c in below)


def _places(df: DataFrame, value: str, order: str, parts: int = 200) -> DataFrame:
    """(__v, __p, __q): values that aren't null, their place in the numeric order from 0, and the value before.

    Rows are numbered within ranges of the order; only a row a range is numbered in one task.
    """
    x = df.select(F.col(value).cast("double").alias("__v"), F.col(order).cast("double").alias("__o"), F.col(order).alias("__key"), F.xxhash64(order, value).alias("__x")).filter("`__v` is not null")
    cuts = x.approxQuantile("__o", [k / parts for k in range(1, parts)], 0.5 / parts)
    n_below = sum((F.col("__o") >= c).cast("int") for c in sorted(set(cuts))) if cuts else F.lit(0)
    x = x.withColumn("__b", F.coalesce(n_below, F.lit(-1)))  # a null order comes first
    w = Window.partitionBy("__b").orderBy("__key", "__x")
    x = x.withColumns({"__i": F.row_number().over(w) - 1, "__q": F.lag("__v").over(w)})
    last = x.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"), F.max_by("__v", "__i").alias("__end"))
    o = Window.orderBy("__b")
    last = last.select("__b", F.coalesce(F.sum("__n").over(o.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__from"), F.lag("__end").over(o).alias("__before"))
    return x.join(F.broadcast(last), "__b").select("__v", (F.col("__from") + F.col("__i")).alias("__p"), F.coalesce("__q", "__before").alias("__q"))


def _replicated(rows: DataFrame, replicates: int) -> DataFrame:
    return rows.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))


def bootstrap_block_mean(df: DataFrame, value: str, order: str, replicates: int, block: int, seed: int = 42) -> DataFrame:
    """(rep, value): means of circular block resamples of a column of any size: the block of ``block`` rows from each place,
    around the end, counts a Poisson number of times with mean 1 / block. Sums of blocks come first, so nothing is copied but
    they; a replicate is one combined sum. Without rows there are no replicates; one without blocks has a null value."""
    x = _places(df, value, order)
    n = x.count()
    back = F.explode(F.sequence(F.lit(0), F.lit(block - 1)))
    starts = x.select("__v", "__p", back.alias("__d")).select("__v", F.pmod(F.col("__p") - F.col("__d"), F.lit(max(1, n))).alias("__s"))
    sums = _replicated(starts.groupBy("__s").agg(F.sum("__v").alias("__t")), replicates).withColumn("__k", _poisson(1 / block, "__s", "rep", F.lit(seed)))
    return sums.groupBy("rep").agg(F.try_divide(F.sum(F.col("__k") * F.col("__t")), F.sum("__k") * block).alias("value")).select(F.col("rep").cast("long").alias("rep"), "value")


def bootstrap_lag_slope(df: DataFrame, value: str, order: str, replicates: int, seed: int = 42) -> DataFrame:
    """(rep, value): slopes of a value on the one before it, over Poisson resamples of all such pairs; sums of cross products."""
    x = _places(df, value, order).filter("`__q` is not null")
    m = x.agg(F.avg("__v"), F.avg("__q")).first()
    y, z = F.col("__v") - F.lit(m[0]), F.col("__q") - F.lit(m[1])  # about the means, for exact sums
    k = F.col("__k")
    s = _replicated(x.select("__p", y.alias("y"), z.alias("z")), replicates).withColumn("__k", _poisson(1.0, "__p", "rep", F.lit(seed)))
    s = s.groupBy("rep").agg(F.sum(k).alias("n"), *[F.sum(k * e).alias(a) for a, e in (("sy", F.col("y")), ("sz", F.col("z")), ("yz", F.col("y") * F.col("z")), ("zz", F.col("z") * F.col("z")))])
    return s.select(F.col("rep").cast("long").alias("rep"), F.expr("try_divide(n * yz - sy * sz, n * zz - sz * sz)").alias("value"))


def bootstrap_sums(df: DataFrame, value: str, replicates: int, seed: int = 42, key: Sequence[str] = ()) -> DataFrame:
    """(rep, n, mean) of Poisson resamples of a column of any size: each row counts as often as a hash of (row, replicate)
    says, so that every replicate is a sum in one aggregate; nothing is copied. Rows are told apart by ``key`` (and value),
    so replicates don't depend on the layout; without a key, rows of equal value are drawn together."""
    rows = df.select(F.col(value).cast("double").alias("__v"), F.xxhash64(*key, value).alias("__i")).filter("`__v` is not null")
    sums = []
    for rep in range(replicates):
        k = _poisson(1.0, "__i", F.lit(rep), F.lit(seed))
        sums += [F.sum(k).alias(f"n{rep}"), F.sum(k * F.col("__v")).alias(f"s{rep}")]
    one = rows.agg(*sums)
    pairs = F.array(*[F.struct(F.lit(rep).cast("long").alias("rep"), F.col(f"n{rep}").alias("n"), F.col(f"s{rep}").alias("s")) for rep in range(replicates)])
    return one.select(F.inline(pairs)).select("rep", "n", F.try_divide("s", "n").alias("mean"))


def bootstrap_summary(draws: DataFrame, level: float = 0.95, value: str = "value") -> DataFrame:
    """n, mean, se, percentile interval at the floor and ceiling positions, and the sign p-value."""
    w = Window.partitionBy(F.lit(0))
    a = (1 - level) / 2
    s = draws.withColumn("__k", F.row_number().over(w.orderBy(value)) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
    lo, hi = F.floor(F.lit(a) * F.col("__n")), F.least(F.col("__n") - 1, F.ceil(F.lit(1 - a) * F.col("__n")) - 1)
    side = F.least(F.sum((F.col(value) <= 0).cast("int")), F.sum((F.col(value) >= 0).cast("int")))
    return s.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("se"), F.max(F.when(F.col("__k") == lo, F.col(value))).alias("lower"),
                 F.max(F.when(F.col("__k") == hi, F.col(value))).alias("upper"), F.least(F.lit(1.0), 2 * side / F.count(F.lit(1))).alias("p"))


# --- samplers: plain numpy, one chain a task ---------------------------------------------------------------------------


def metropolis_hastings(logp: Callable, x0, n: int, burn: int, rng, scale=None, thin: int = 1) -> tuple[np.ndarray, float]:
    """Random walk with a diagonal normal; while burning in, steps grow or shrink by a tenth towards an acceptance of 0.234."""
    x = np.array(x0, float)
    sd = np.full(len(x), 0.5) if scale is None else np.array(scale, float)
    cur, out, hits, recent = logp(x), [], 0, 0
    for i in range(burn + n * thin):
        new = x + sd * rng.standard_normal(len(x))
        v = logp(new)
        if math.log(rng.random() + 1e-300) < v - cur:
            x, cur, recent = new, v, recent + 1
            hits += i >= burn
        if i < burn and (i + 1) % WALK_EVERY == 0:
            sd, recent = sd * (WALK_UP if recent / WALK_EVERY > WALK_GOAL else WALK_DOWN), 0
        if i >= burn and (i - burn + 1) % thin == 0:
            out.append(x.copy())
    return np.array(out), hits / max(1, n * thin)


def adaptive_metropolis(logp: Callable, x0, n: int, burn: int, rng, thin: int = 1, start_sd=0.1) -> tuple[np.ndarray, float]:
    """Proposals of covariance 2.38^2 / d times that of the chain so far."""
    x = np.array(x0, float)
    d = len(x)
    cur, out, hits = logp(x), [], 0
    mean, cov, seen = x.copy(), np.zeros((d, d)), 1
    low = np.diag(np.broadcast_to(np.asarray(start_sd, float), (d,)))
    for i in range(burn + n * thin):
        new = x + low @ rng.standard_normal(d)
        v = logp(new)
        if math.log(rng.random() + 1e-300) < v - cur:
            x, cur = new, v
            hits += i >= burn
        seen += 1
        dx = x - mean
        mean = mean + dx / seen
        cov = cov + np.outer(dx, x - mean)
        if seen > ADAPT_FROM and seen % ADAPT_EVERY == 0:
            try:
                low = np.linalg.cholesky(ADAPT_SCALE / d * (cov / (seen - 1) + ADAPT_RIDGE * np.eye(d)))
            except np.linalg.LinAlgError:
                pass
        if i >= burn and (i - burn + 1) % thin == 0:
            out.append(x.copy())
    return np.array(out), hits / max(1, n * thin)


def numerical_gradient(logp: Callable, x: np.ndarray, h: float = 1e-5) -> np.ndarray:
    return np.array([(logp(x + e) - logp(x - e)) / (2 * h) for e in np.eye(len(x)) * h])


def hmc(logp: Callable, x0, n: int, burn: int, rng, grad: Callable | None = None, steps: int = 20, eps: float = 0.1, inverse_mass=None, goal: float = 0.65) -> tuple[np.ndarray, float]:
    """Leapfrog paths; while burning in, the step size follows dual averaging towards the wanted acceptance."""
    g = grad or (lambda v: numerical_gradient(logp, v))
    x = np.array(x0, float)
    im = np.ones(len(x)) if inverse_mass is None else np.array(inverse_mass, float)
    cur, out, hits = logp(x), [], 0
    drift, slow, centre = 0.0, math.log(eps), math.log(10 * eps)
    for i in range(burn + n):
        m = rng.standard_normal(len(x)) / np.sqrt(im)
        q, p = x.copy(), m + 0.5 * eps * g(x)
        for s in range(steps):
            q = q + eps * im * p
            p = p + (eps if s < steps - 1 else 0.5 * eps) * g(q)
        v = logp(q)
        a = v - cur - 0.5 * (im * p * p).sum() + 0.5 * (im * m * m).sum()
        chance = min(1.0, math.exp(min(0.0, a))) if a == a else 0.0
        if rng.random() < chance:
            x, cur = q, v
            hits += i >= burn
        if i < burn:
            t = i + 1
            drift = (1 - 1 / (t + DUAL_OFFSET)) * drift + (goal - chance) / (t + DUAL_OFFSET)
            le = centre - math.sqrt(t) / DUAL_SHRINK * drift
            slow = t**-DUAL_POWER * le + (1 - t**-DUAL_POWER) * slow
            eps = math.exp(le if t < burn else slow)
        else:
            out.append(x.copy())
    return np.array(out), hits / max(1, n)


def slice_sampling(logp: Callable, x0, n: int, burn: int, rng, width: float = 1.0) -> tuple[np.ndarray, float]:
    """By coordinate: steps out up to 32 times, shrinks up to 200."""
    x, out = np.array(x0, float), []
    for i in range(burn + n):
        for j in range(len(x)):
            at = lambda v: logp(np.concatenate((x[:j], [v], x[j + 1 :])))  # noqa: E731, B023
            level = logp(x) + math.log(rng.random() + 1e-300)
            lo = x[j] - width * rng.random()
            hi = lo + width
            for _ in range(STEPS_OUT):
                if at(lo) < level:
                    break
                lo -= width
            for _ in range(STEPS_OUT):
                if at(hi) < level:
                    break
                hi += width
            for _ in range(SHRINKS):
                v = rng.uniform(lo, hi)
                if at(v) >= level:
                    x[j] = v
                    break
                lo, hi = (v, hi) if v < x[j] else (lo, v)
        if i >= burn:
            out.append(x.copy())
    return np.array(out), 1.0


def gibbs(logp: Callable | None, x0, n: int, burn: int, rng, conditionals: Sequence[tuple[Sequence[int], Callable]] = (), thin: int = 1) -> tuple[np.ndarray, float]:
    """Each block (positions, sampler(x, rng)) in turn. The log density isn't needed to draw; sample_chains reports it."""
    x, out = np.array(x0, float), []
    for i in range(burn + n * thin):
        for at, draw in conditionals:
            x[list(at)] = draw(x, rng)
        if i >= burn and (i - burn) % thin == 0:
            out.append(x.copy())
    return np.array(out), 1.0


SAMPLERS = {"metropolis": metropolis_hastings, "adaptive": adaptive_metropolis, "hmc": hmc, "slice": slice_sampling, "gibbs": gibbs}


def sample_chains(spark: SparkSession, logp: Callable | None, x0: Sequence[float], n: int = 1000, burn: int = 500, chains: int = 4, sampler: str = "metropolis", seed: int = 42, spread: float = 0.1, density: bool = False, **options) -> DataFrame:
    """(chain, draw, param, value), and with ``density`` lp, the log density of the draw: chains are independent tasks, from
    spread starts and own seeds. Only gibbs can do without a log density."""
    start = np.array(x0, float)
    if logp is None and (density or sampler != "gibbs"):
        raise ValueError("a log density is needed")

    def run(batches):
        for pdf in batches:
            for c in pdf["id"]:
                rng = np.random.Generator(np.random.PCG64([seed, int(c)]))
                x = start + (np.abs(start) + 1) * spread * rng.standard_normal(len(start)) if c else start
                s, _ = SAMPLERS[sampler](logp, x if logp is None or math.isfinite(logp(x)) else start, n, burn, rng, **options)
                k = s.shape[1]
                out = pd.DataFrame({"chain": int(c), "draw": np.repeat(np.arange(len(s)), k), "param": np.tile(np.arange(k), len(s)), "value": s.ravel()})
                yield out.assign(lp=np.repeat([float(logp(v)) for v in s], k)) if density else out

    return spark.range(chains, numPartitions=chains).mapInPandas(run, "chain long, draw long, param long, value double" + (", lp double" if density else ""))


# --- what chains say ------------------------------------------------------------------------------------------------------


def chain_summary(draws: DataFrame, level: float = 0.95) -> DataFrame:
    """By parameter over all chains: mean, sd, median x[n/2], interval at floor(a n) and floor((1-a) n)."""
    a = (1 - level) / 2
    w = Window.partitionBy("param")
    s = draws.withColumn("__n", F.count(F.lit(1)).over(w)).withColumn("__k", F.row_number().over(w.orderBy("value")) - 1)
    at = lambda e, name: F.max(F.when(F.col("__k") == F.least(F.floor(e * F.col("__n")), F.col("__n") - 1), F.col("value"))).alias(name)
    return s.groupBy("param").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), at(F.lit(0.5), "median"), at(F.lit(a), "lower"), at(F.lit(1 - a), "upper"))


def gelman_rubin(draws: DataFrame) -> DataFrame:
    """Potential scale reduction by parameter, of whole chains."""
    c = draws.groupBy("param", "chain").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    s = c.groupBy("param").agg(F.count(F.lit(1)).alias("chains"), F.avg("n").alias("n"), F.var_samp("m").alias("bm"), F.avg("v").alias("w"))
    return s.select("param", "chains", F.sqrt(((F.col("n") - 1) / F.col("n") * F.col("w") + F.col("bm")) / F.nullif("w", F.lit(0.0))).alias("rhat")).withColumn("converged", F.col("rhat") < 1.1)


def effective_size(x: np.ndarray) -> float:
    """n / (1 + 2 sum of autocorrelations) of lags under n / 2, up to the first under MIXED; 1 at least, and n of under four
    draws or of a constant."""
    n = len(x)
    x = x - x.mean()
    v = float((x * x).sum())
    if n < 4 or v / n < 1e-30:
        return float(n)
    s = 0.0
    for k in range(1, min(n - 1, n // 2)):
        r = float((x[k:] * x[:-k]).sum()) / v
        if r < MIXED:
            break
        s += r
    return max(1.0, n / (1 + 2 * s))


def effective_sample_size(draws: DataFrame) -> DataFrame:
    """(n, ess) of each (chain, param)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("draw")["value"].to_numpy()
        return pd.DataFrame([(pdf["chain"].iloc[0], pdf["param"].iloc[0], len(x), effective_size(x))], columns=["chain", "param", "n", "ess"])

    return draws.groupBy("chain", "param").applyInPandas(run, "chain long, param long, n long, ess double")


def chain_autocorrelation(draws: DataFrame, max_lag: int) -> DataFrame:
    """Lags 0..max_lag of each (chain, param)."""
    from .diagnostics import autocorrelation

    return autocorrelation(draws, "value", max_lag, ["chain", "param"], ["draw"], lag0=True)


def geweke(draws: DataFrame, first: float = 0.1, last: float = 0.5) -> DataFrame:
    """z of the means of the first tenth and the last half of each chain."""
    s = with_seq(draws, ["chain", "param"], ["draw"]).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("chain", "param")))
    a, b = F.col("seq") < F.floor(first * F.col("__n")), F.col("seq") >= F.col("__n") - F.floor(last * F.col("__n"))
    agg = [f(F.when(c, F.col("value"))).alias(n) for c, t in ((a, "a"), (b, "b")) for f, n in ((F.avg, f"m{t}"), (F.var_samp, f"v{t}"), (F.count, f"n{t}"))]
    s = s.groupBy("chain", "param").agg(*agg)
    return s.select("chain", "param", F.try_divide(F.col("ma") - F.col("mb"), F.sqrt(F.col("va") / F.col("na") + F.col("vb") / F.col("nb"))).alias("z"))


def chain_diagnostics(draws: DataFrame) -> DataFrame:
    acf = chain_autocorrelation(draws, 1).filter("lag = 1").select("chain", "param", F.col("acf").alias("acf1"))
    return effective_sample_size(draws).join(acf, ["chain", "param"]).join(geweke(draws), ["chain", "param"])


def harmonic_marginal_likelihood(ll: DataFrame, col: str = "ll") -> DataFrame:
    """log of the harmonic mean of likelihoods, from their logs."""
    low = ll.agg(F.min(col).alias("lo"), F.count(F.lit(1)).alias("n"))
    return ll.join(F.broadcast(low)).groupBy("lo", "n").agg(F.sum(F.exp(F.col("lo") - F.col(col))).alias("s")).select((F.col("lo") + F.log("n") - F.log("s")).alias("log_ml"))  # low is one row


def waic(point: DataFrame) -> DataFrame:
    """-2 (lppd - p) from (draw, obs, ll): p sums the sample variance of each observation's log likelihood."""
    w = Window.partitionBy("obs")
    o = point.withColumn("__m", F.max("ll").over(w)).groupBy("obs").agg((F.max("__m") + F.log(F.avg(F.exp(F.col("ll") - F.col("__m"))))).alias("lp"), F.var_samp("ll").alias("v"))
    return o.agg(F.sum("lp").alias("lppd"), F.sum("v").alias("p_waic"), (-2 * (F.sum("lp") - F.sum("v"))).alias("waic"))


# --- Bayesian volatility ---------------------------------------------------------------------------------------------------


def garch_log_prior(p: Sequence[float], prior: dict[str, float] = GARCH_PRIOR) -> float:
    """Up to a constant: gamma on omega, beta densities on alpha / 0.5 and on beta."""
    w, a, b = p
    if w <= 0 or not 0 < a < 0.5 or not 0 < b < 1 or a + b >= 1:
        return -math.inf
    q = prior
    return ((q["omega_shape"] - 1) * math.log(w) - q["omega_rate"] * w + (q["alpha_a"] - 1) * math.log(2 * a) + (q["alpha_b"] - 1) * math.log1p(-2 * a)
            + (q["beta_a"] - 1) * math.log(b) + (q["beta_b"] - 1) * math.log1p(-b))


def gjr_log_prior(p: Sequence[float], nu_fixed: float | None, prior: dict[str, float] = GJR_PRIOR) -> float:
    """Up to a constant: exponential on omega, heavy tails on alpha and gamma, a beta density on beta, a power of nu if it is estimated."""
    w, a, g, b = p[:4]
    nu = p[4] if nu_fixed is None else nu_fixed
    if w <= 0 or a < 0 or g < 0 or not 0 < b < 1 or a + g / 2 + b >= 1 or not 2 < nu <= prior["nu_most"]:
        return -math.inf
    q = prior
    out = -q["omega_rate"] * w - q["alpha_power"] * math.log1p(q["alpha_scale"] * a) - q["gamma_power"] * math.log1p(q["gamma_scale"] * g)
    return out + (q["beta_a"] - 1) * math.log(b) + (q["beta_b"] - 1) * math.log1p(-b) - (q["nu_power"] * math.log(nu) if nu_fixed is None else 0.0)


def bayesian_volatility(df: DataFrame, r: str, by: Sequence[str], order: Sequence[str], kind: str = "garch", n: int = 2000, burn: int = 1000, seed: int = 42, nu: float | None = None,
                        prior: dict[str, float] | None = None) -> DataFrame:
    """(by, chain, draw, param, value, ll): adaptive chains from the maximum likelihood fit, a task a series. kind: garch
    (normal) or gjr (unstandardised t with its own, or the given, degrees of freedom). ll is the log likelihood of the draw.
    prior: values that replace those of GARCH_PRIOR or GJR_PRIOR; omega's are on the scale of the returns' variance."""
    beliefs = (GARCH_PRIOR if kind == "garch" else GJR_PRIOR) | (prior or {})
    kinds = dict(df.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in by], "chain long, draw long, param string, value double, ll double"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = {k: pdf[k].iloc[0] for k in by}
        x = pdf.sort_values(list(order))[r].dropna().to_numpy(float)
        f = fit_volatility(kind, x)
        if f["status"] != "ok":
            return pd.DataFrame(columns=[*by, "chain", "draw", "param", "value", "ll"])
        e = x - f["mu"]
        names = list(f["params"]) + (["nu"] if kind == "gjr" and nu is None else [])
        unit = float(e.var())  # omega moves on the scale of the variance
        start = np.array([*f["params"].values(), *([8.0] if len(names) == 5 else [])])
        start[0] /= unit

        def ll(v):
            p = np.array(v, float)
            p[0] *= unit
            if kind == "garch":
                return log_likelihood("garch", p, e)
            h = _variance("gjr", p[:4], e)
            if h is None:
                return -math.inf
            k = p[4] if nu is None else nu
            c = student_t_logpdf(0.0, k)
            return float((c - (k + 1) / 2 * np.log1p(e * e / h / k) - 0.5 * np.log(h)).sum())

        def post(v):
            p = np.array(v, float)
            p[0] *= unit
            q = garch_log_prior(p, beliefs) if kind == "garch" else gjr_log_prior(p, nu, beliefs)
            return q + ll(v) if q > -math.inf else q

        if not math.isfinite(post(start)):
            start = np.array([0.05, 0.05, 0.9] if kind == "garch" else [0.05, 0.05, 0.02, 0.88, 8.0][: len(names)])
        scale = np.array([max(0.3 * start[0], 1e-12), *[0.02] * (len(start) - 1)])
        if len(names) == 5:
            scale[4] = 0.5
        s, _ = adaptive_metropolis(post, start, n, burn, np.random.Generator(np.random.PCG64(seed)), start_sd=scale)
        lls = np.array([ll(v) for v in s])
        s[:, 0] *= unit
        k = s.shape[1]
        return pd.DataFrame({**{c: [v] * s.size for c, v in own.items()}, "chain": 0, "draw": np.repeat(np.arange(len(s)), k), "param": np.tile(names, len(s)), "value": s.ravel(), "ll": np.repeat(lls, k)})

    return df.select(*{*by, *order, r}).groupBy(*by).applyInPandas(run, schema)


def dic(draws: DataFrame, ll_at_mean: DataFrame, by: Sequence[str]) -> DataFrame:
    """Deviance information criterion from the draws' log likelihoods and that at the posterior mean (by, ll_mean)."""
    d = draws.select(*by, "chain", "draw", "ll").distinct().groupBy(*by).agg((-2 * F.avg("ll")).alias("d"))
    return d.join(ll_at_mean, list(by)).select(*by, (2 * F.col("d") + 2 * F.col("ll_mean")).alias("dic"))


def predictive(draws: DataFrame, returns: DataFrame, r: str, by: Sequence[str], order: Sequence[str], kind: str = "garch", n_ahead: int = 10, n_posterior: int = 200, seed: int = 42) -> DataFrame:
    """(by, h, mean, volatility, lower, upper): about n_posterior draws replay the variance and simulate on, with normal
    shocks, or with kind gjr t shocks of the draw's nu."""
    kinds = dict(returns.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in by], "draw long, h long, ret double"])

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        x = right.sort_values(list(order))[r].dropna().to_numpy(float)
        p = left.pivot_table(index="draw", columns="param", values="value")
        p = p.iloc[:: max(1, len(p) // n_posterior)]
        rng = np.random.Generator(np.random.PCG64(seed))
        names = ["omega", "alpha", "beta"] if kind == "garch" else ["omega", "alpha", "gamma", "beta"]
        out, mu = [], float(x.mean()) if len(x) else 0.0
        for d, v in p.iterrows():
            q = [v[c] for c in names]
            h = _variance(kind, q, x - mu)
            if h is None or not len(x):
                continue
            e, last = x[-1] - mu, h[-1]
            for s in range(n_ahead):
                last = q[0] + (q[1] + (q[2] * (e < 0) if kind == "gjr" else 0.0)) * e * e + q[-1] * last
                k = v.get("nu", 8.0)
                shock = rng.standard_normal() if kind == "garch" else rng.standard_normal() / math.sqrt(rng.chisquare(k) / k)
                e = math.sqrt(last) * shock
                out.append((*key, int(d), s + 1, mu + e))
        return pd.DataFrame(out, columns=[*by, "draw", "h", "ret"])

    sims = draws.groupBy(*by).cogroup(returns.groupBy(*by)).applyInPandas(run, schema)
    q = F.percentile("ret", F.array(F.lit(0.025), F.lit(0.975)))
    return sims.groupBy(*by, "h").agg(F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("volatility"), q.alias("q")).select(*by, "h", "mean", "volatility", F.get("q", F.lit(0)).alias("lower"), F.get("q", F.lit(1)).alias("upper"))


