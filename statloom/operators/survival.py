"""Survival analysis and reliability on event tables (distinct times with counts)."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import dist
from ..functions.special import norm_logcdf, norm_logpdf, softplus
from ..plans.frames import collect_bounded, complete, fetch, level_key, levels_of, need, num, one_row, refuse, rows_frame
from ..plans.mle import fit_mle
from ..plans.order import cumulate, in_order, quantiles, running, same_keys
from .describe import weibull_shape


def event_table(df: DataFrame, duration: str, event: Column, keys: Sequence[str] = (), **more: Column) -> DataFrame:
    """Per key and time: events `d`, censored `c`, number at risk, Kaplan-Meier survival before and after, in the order of `__id`."""
    keys = list(keys)
    d = df.withColumn("__e", event).where((F.col(duration) > 0) & F.col("__e").isNotNull())
    g = d.groupBy(*keys, F.col(duration).cast("double").alias("t")).agg(F.sum(F.when(F.col("__e") > 0, 1).otherwise(0)).alias("d"), F.count(F.lit(1)).alias("m"),
                                                                        *[F.sum(c).alias(k) for k, c in more.items()])
    # at risk: rows of the key at this time or later, that is all but the earlier ones
    size = g.groupBy(*keys).agg(F.sum("m").alias("__size"))
    g = same_keys(g, size, keys) if keys else g.crossJoin(F.broadcast(size))      # one row
    r = running(in_order(g, "t", keys), ["m"], keys).withColumn("at_risk", F.col("__size") - F.col("m_before")).drop("m_before", "__size")
    dead = F.col("d") >= F.col("at_risk")
    r = r.withColumn("__l", F.when(dead, F.lit(0.0)).otherwise(F.log1p(-F.col("d") / F.col("at_risk")))).withColumn("__z", F.when(dead, 1).otherwise(0))
    c = running(r, ["__l", "__z"], keys)
    before = F.when(F.col("__z_before") > 0, 0.0).otherwise(F.exp(F.col("__l_before")))
    after = F.when(F.col("__z_before") + F.col("__z") > 0, 0.0).otherwise(F.exp(F.col("__l_before") + F.col("__l")))
    return c.select(*keys, "t", "d", (F.col("m") - F.col("d")).alias("c"), "at_risk", before.alias("s_before"), after.alias("s"), *more, "__id")


def kaplan_meier(df: DataFrame, duration: str, event: str, group: str | None = None) -> DataFrame:
    """Survival at every event or censoring time."""
    need(df, duration, event, group)
    return event_table(df, duration, num(event), [group] if group else []).select(*([group] if group else []), "t", "d", "c", "at_risk", F.col("s").alias("survival"))


def log_rank(df: DataFrame, duration: str, event: str, group: str) -> tuple[float, float]:
    lv = levels_of(df, group, 2)
    refuse(len(lv) != 2, "the log-rank test needs two groups")
    d = df.withColumn("__e", num(event)).where(F.col(duration) > 0)
    first = F.col(group) == F.lit(lv[0])
    g = d.groupBy(F.col(duration).cast("double").alias("t")).agg(F.sum("__e").alias("d"), F.count(F.lit(1)).alias("m"), F.sum(F.when(first, F.col("__e")).otherwise(0)).alias("d1"),
                                                                 F.sum(F.when(first, 1).otherwise(0)).alias("m1"))
    r = cumulate(g, "t", ["m", "m1"], (), descending=True)
    n, n1 = F.col("m") + F.col("m_before"), F.col("m1") + F.col("m1_before")
    s = fetch(r, o=F.sum("d1"), e=F.sum(F.col("d") * n1 / n), v=F.sum(F.when(n > 1, F.col("d") * (n1 / n) * (1 - n1 / n) * (n - F.col("d")) / (n - 1)).otherwise(0.0)))
    return s["o"] - s["e"], s["v"]


def cox_fit(df: DataFrame, stop: str, event: str, covariates: Sequence[str], strata: str | None = None, start: str | None = None, most: int = 30, tol: float = 1e-8) -> dict:
    """Cox partial likelihood with Efron ties by Newton steps.

    Each step sums exp(x'b), its products with x and the event sums per distinct time, turns them into risk-set
    sums by one running sum from the last time backwards, and aggregates. Late entry enters as negative rows at
    the start time, so (start, stop] data need no pairing of rows with event times.
    """
    xs = list(covariates)
    k = len(xs)
    d = complete(df, [stop, event, *xs] + ([start] if start else []), [strata] if strata else []).where(F.col(stop) > 0)
    mom = fetch(d, **{f"m{i}": F.avg(c) for i, c in enumerate(xs)}, **{f"s{i}": F.stddev_pop(c) for i, c in enumerate(xs)}, ev=F.sum(event))
    refuse(not mom["ev"] or mom["ev"] < 2 * k + 2, "too few events for the covariates")
    sc = np.array([mom[f"s{i}"] or 1.0 for i in range(k)])
    z = d.select(*([strata] if strata else []), F.col(stop).alias("t"), F.col(event).alias("e"), *([F.col(start).alias("t0")] if start else []),
                 *[((F.col(c) - F.lit(mom[f"m{i}"])) / F.lit(float(sc[i]))).alias(f"x{i}") for i, c in enumerate(xs)]).persist()
    keys = [strata] if strata else []
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def table(b):
        eta = sum([F.col(f"x{i}") * F.lit(float(b[i])) for i in range(k)], F.lit(0.0))
        rows = z.select(*keys, "t", "e", F.lit(1.0).alias("sg"), *[f"x{i}" for i in range(k)])
        if start:
            rows = rows.unionByName(z.select(*keys, F.col("t0").alias("t"), F.lit(0.0).alias("e"), F.lit(-1.0).alias("sg"), *[f"x{i}" for i in range(k)]))
        rows = rows.withColumn("w", F.exp(eta))
        sums = {"s0": F.col("sg") * F.col("w"), **{f"s1_{i}": F.col("sg") * F.col("w") * F.col(f"x{i}") for i in range(k)},
                **{f"s2_{i}_{j}": F.col("sg") * F.col("w") * F.col(f"x{i}") * F.col(f"x{j}") for i, j in pairs}}
        ev = {"d": F.col("e"), "le": F.col("e") * eta, "e0": F.col("e") * F.col("w"), **{f"ex_{i}": F.col("e") * F.col(f"x{i}") for i in range(k)},
              **{f"e1_{i}": F.col("e") * F.col("w") * F.col(f"x{i}") for i in range(k)}, **{f"e2_{i}_{j}": F.col("e") * F.col("w") * F.col(f"x{i}") * F.col(f"x{j}") for i, j in pairs}}
        g = rows.groupBy(*keys, "t").agg(*[F.sum(c).alias(n) for n, c in {**sums, **ev}.items()])
        c = cumulate(g, "t", list(sums), keys, descending=True)
        # A start at time t does not count at t itself (start < t): entries at t are in the running sum of later
        # rows only when strictly later, so the risk set at t takes its own positive part plus what comes after.
        if start:
            own = z.withColumn("w", F.exp(eta)).groupBy(*keys, "t").agg(F.sum("w").alias("p0"), *[F.sum(F.col("w") * F.col(f"x{i}")).alias(f"p1_{i}") for i in range(k)],
                                                                        *[F.sum(F.col("w") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p2_{i}_{j}") for i, j in pairs])
            c = c.where("d > 0").join(own, [*keys, "t"])
            tot = {n: F.col(n.replace("s", "p", 1)) + F.col(f"{n}_before") for n in sums}
        else:
            tot = {n: F.col(n) + F.col(f"{n}_before") for n in sums}
        return c.select(*keys, "t", *ev, *[v.alias(f"r_{n}") for n, v in tot.items()]).where("d > 0")

    def at(b):
        t = table(b).withColumn("l", F.explode(F.sequence(F.lit(0), (F.col("d") - 1).cast("int")))).withColumn("f", F.col("l") / F.col("d"))
        den = F.col("r_s0") - F.col("f") * F.col("e0")
        a = [(F.col(f"r_s1_{i}") - F.col("f") * F.col(f"e1_{i}")) / den for i in range(k)]
        q = {"ll": F.sum(F.col("le") / F.col("d") - F.log(den))}
        for i in range(k):
            q[f"g{i}"] = F.sum(F.col(f"ex_{i}") / F.col("d") - a[i])
        for i, j in pairs:
            q[f"h{i}_{j}"] = F.sum((F.col(f"r_s2_{i}_{j}") - F.col("f") * F.col(f"e2_{i}_{j}")) / den - a[i] * a[j])
        r = fetch(t, **q)
        h = np.zeros((k, k))
        for i, j in pairs:
            h[i, j] = h[j, i] = r[f"h{i}_{j}"]
        return r["ll"], np.array([r[f"g{i}"] for i in range(k)]), h

    try:
        b = np.zeros(k)
        ll, g, h = at(b)
        ll0 = ll
        for _ in range(most):
            step = np.linalg.lstsq(h, g, rcond=None)[0]
            if float(g @ step) < tol * (1 + abs(ll)):
                break
            f = 1.0
            while True:
                cand = at(b + f * step)
                if cand[0] >= ll - 1e-10 * abs(ll) or f < 1e-3:
                    break
                f /= 2
            b = b + f * step
            ll, g, h = cand
        cov = np.linalg.pinv(h, hermitian=True)
        res = {"beta": b / sc, "vcov": cov / np.outer(sc, sc), "ll": ll, "ll0": ll0, "events": int(mom["ev"]), "n": d.count()}
        risk = table(b).select(*keys, "t", *[(F.col(f"r_s1_{i}") / F.col("r_s0")).alias(f"mean{i}") for i in range(k)])
        ev = z.where("e > 0").join(risk, [*keys, "t"]).select("t", *[((F.col(f"x{i}") - F.col(f"mean{i}")) * F.lit(float(sc[i]))).alias(f"sch{i}") for i in range(k)])
        res["schoenfeld"] = ev
        return res
    finally:
        z.unpersist()


def _cox_frame(df, xs, f):
    se = np.sqrt(np.diag(f["vcov"]))
    rows = [(x, float(b), float(math.exp(b)), float(s), float(b / s), dist.p_two_sided(b / s), f["n"], f["events"], f["ll"], 2 * (f["ll"] - f["ll0"]))
            for x, b, s in zip(xs, f["beta"], se)]
    return rows_frame(df.sparkSession, "covariate string, coef double, hazard_ratio double, se double, z double, p double, n bigint, events bigint, loglik double, lr_chi2 double", rows)


def cox_regression(df: DataFrame, duration: str, event: str, covariates: Sequence[str]) -> DataFrame:
    return _cox_frame(df, covariates, cox_fit(df, duration, event, covariates))


def stratified_cox(df: DataFrame, duration: str, event: str, covariates: Sequence[str], strata: str) -> DataFrame:
    return _cox_frame(df, covariates, cox_fit(df, duration, event, covariates, strata))


def time_varying_cox(df: DataFrame, start: str, stop: str, event: str, covariates: Sequence[str]) -> DataFrame:
    return _cox_frame(df, covariates, cox_fit(df, stop, event, covariates, None, start))


def cox_ph_diagnostics(df: DataFrame, duration: str, event: str, covariates: Sequence[str]) -> DataFrame:
    """Correlation of the scaled Schoenfeld residuals with rank time, per covariate."""
    from ..plans.order import with_average_rank
    f = cox_fit(df, duration, event, covariates)
    k = len(covariates)
    v = f["vcov"] * f["events"]
    s = f["schoenfeld"].select("t", *[sum([F.col(f"sch{j}") * F.lit(float(v[i, j])) for j in range(k)], F.lit(0.0)).alias(f"r{i}") for i in range(k)])
    r = with_average_rank(s, "t", "rank")
    m = fetch(r, n=F.count(F.lit(1)), **{f"c{i}": F.covar_pop(f"r{i}", "rank") / F.sqrt(F.var_pop(f"r{i}") * F.var_pop("rank")) for i in range(k)})
    n = m["n"]
    rows = []
    for i, c in enumerate(covariates):
        rho = m[f"c{i}"]
        rows.append((c, n, rho, n * rho * rho, dist.chi2_sf(n * rho * rho, 1)))
    return rows_frame(df.sparkSession, "covariate string, events bigint, rho double, chi2 double, p double", rows)


def survival_analysis(df: DataFrame, duration: str, event: str, group: str | None = None) -> DataFrame:
    """Median survival per group (-1 when never reached), events, and the log-rank test of two groups."""
    need(df, duration, event, group)
    keys = [group] if group else []
    d = df if group else df
    t = event_table(d, duration, num(event), keys)
    m = t.groupBy(*keys).agg(F.sum(F.col("d") + F.col("c")).alias("n"), F.sum("d").alias("events"), F.coalesce(F.min(F.when(F.col("s") <= 0.5, F.col("t"))), F.lit(-1.0)).alias("median"))
    if not group:
        return m
    oe, v = log_rank(df, duration, event, group)
    x = oe * oe / v if v > 0 else float("nan")
    return m.select(F.col(group).cast("string").alias("level"), "n", "events", "median", F.lit(x).alias("logrank_chi2"), F.lit(dist.chi2_sf(x, 1)).alias("logrank_p"))


def competing_risks(df: DataFrame, duration: str, status: str, group: str, event_of_interest: int = 1) -> DataFrame:
    """Aalen-Johansen cumulative incidence of one cause per group at the .2 ... 1 quantiles of duration."""
    need(df, duration, status, group)
    s = num(status)
    t = event_table(df, duration, s, [group], dk=F.when(s == event_of_interest, 1).otherwise(0))
    t = t.withColumn("inc", F.col("s_before") * F.col("dk") / F.col("at_risk"))
    c = running(t, ["inc"], [group]).withColumn("cif", F.col("inc_before") + F.col("inc"))
    qs = quantiles(df, duration, [0.2, 0.4, 0.6, 0.8, 1.0])
    g = c.groupBy(group).agg(F.array(*[F.struct(F.lit(p).alias("q"), F.lit(float(v)).alias("time"), F.max(F.when(F.col("t") <= F.lit(float(v)), F.col("cif"))).alias("cif"))
                                       for p, v in zip((0.2, 0.4, 0.6, 0.8, 1.0), qs)]).alias("a"))
    return g.select(F.col(group).cast("string").alias("level"), F.explode("a").alias("s")).select("level", "s.q", "s.time", F.coalesce("s.cif", F.lit(0.0)).alias("cif"))


def rmst(df: DataFrame, duration: str, event: str, group: str, tau: float | None = None) -> DataFrame:
    """Restricted mean survival per group: area under Kaplan-Meier to tau and its variance.

    The area beyond a time is written through the later drops of the curve, so one running sum gives it.
    """
    need(df, duration, event, group)
    t = event_table(df, duration, num(event), [group]).where("d > 0")
    last = [r["m"] for r in collect_bounded(t.groupBy(group).agg(F.max("t").alias("m")), "groups")]
    common = min(last)
    tv = common if tau is None else min(tau, common)
    t = t.where(F.col("t") <= F.lit(tv)).withColumn("drop", (F.col("s_before") - F.col("s")) * (F.lit(tv) - F.col("t")))
    c = cumulate(t, "t", ["drop"], [group], descending=True)
    rest = F.col("s") * (F.lit(tv) - F.col("t")) - F.col("drop_before")
    y, d = F.col("at_risk"), F.col("d")
    g = c.groupBy(group).agg((F.lit(tv) - F.sum("drop")).alias("rmst"), F.sum(F.when(y > d, rest * rest * d / (y * (y - d))).otherwise(0.0)).alias("var"))
    rows = sorted(collect_bounded(g, "groups"), key=lambda r: level_key(r[group]))
    diff = z = p = float("nan")
    if len(rows) == 2:
        diff = rows[0]["rmst"] - rows[1]["rmst"]
        z = diff / math.sqrt(rows[0]["var"] + rows[1]["var"])
        p = dist.p_two_sided(z)
    return rows_frame(df.sparkSession, "level string, tau double, rmst double, se double, difference double, z double, p double",
                      [(str(r[group]), tv, r["rmst"], math.sqrt(r["var"]), diff, z, p) for r in rows])


def _aft(kind):
    def ll(eta, y):
        mu, ls = eta
        s = np.exp(ls)
        z = (np.log(y["t"]) - mu) / s
        e = y["e"]
        if kind == "lognormal":
            return e * (norm_logpdf(z) - ls - np.log(y["t"])) + (1 - e) * norm_logcdf(-z)
        if kind == "loglogistic":
            return e * (z - 2 * softplus(z) - ls - np.log(y["t"])) - (1 - e) * softplus(z)
        return e * (z - ls - np.log(y["t"])) - np.exp(np.minimum(z, 500))
    return ll


def aft_fit(df: DataFrame, duration: str, event: str, covariates: Sequence[str], kind: str):
    d = complete(df, [duration, event, *covariates]).where(F.col(duration) > 0)
    d = d.select(F.col(duration).alias("t"), F.col(event).alias("e"), *covariates)
    m = fetch(d, m=F.avg(F.log("t")), s=F.stddev_pop(F.log("t")))
    return fit_mle(d, ["t", "e"], [("mu", list(covariates), True), ("log_scale", [], True)], _aft(kind),
                   [[m["m"], *[0.0] * len(covariates)], [math.log(max(m["s"] or 1.0, 1e-3))]])


def parametric_survival(df: DataFrame, duration: str, event: str, covariates: Sequence[str]) -> DataFrame:
    """Weibull, log-normal and log-logistic AFT models by AIC with time ratios."""
    fits = {k: aft_fit(df, duration, event, covariates, k) for k in ("weibull", "lognormal", "loglogistic")}
    best = min(fits, key=lambda k: fits[k].aic)
    rows = [(k, t, b, math.exp(b), s, z, p, f.ll, f.aic, k == best) for k, f in fits.items() for t, b, s, z, p in f.rows()]
    return rows_frame(df.sparkSession, "model string, term string, coef double, exp_coef double, se double, z double, p double, loglik double, aic double, is_best boolean", rows)


def life_table(df: DataFrame, age: str, deaths: str, exposure: str, ax: float = 0.5, radix: float = 100_000.0) -> DataFrame:
    """Period life table from deaths and exposure per age."""
    need(df, age, deaths, exposure)
    d = df.groupBy(num(age).alias("age")).agg((F.sum(num(deaths)) / F.sum(num(exposure))).alias("m"))
    w = Window.orderBy("age")                       # one row per age: a bounded table
    n = F.lead("age").over(w) - F.col("age")
    t = d.withColumn("n", n).withColumn("last", F.col("n").isNull())
    qx = F.when(F.col("last"), 1.0).otherwise(F.least(F.greatest(F.col("n") * F.col("m") / (1 + (F.col("n") - ax * F.col("n")) * F.col("m")), F.lit(0.0)), F.lit(1.0)))
    t = t.withColumn("q", qx)
    lp = F.when((F.col("q") < 1), F.log1p(-F.col("q"))).otherwise(F.lit(-800.0))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("l", F.lit(radix) * F.exp(F.coalesce(F.sum(lp).over(before), F.lit(0.0))))
    t = t.withColumn("d", F.col("l") * F.col("q"))
    t = t.withColumn("big_l", F.when(F.col("last"), F.try_divide(F.col("l"), F.col("m"))).otherwise(F.col("n") * (F.col("l") - F.col("d")) + ax * F.col("n") * F.col("d")))
    t = t.withColumn("big_t", F.sum("big_l").over(Window.orderBy(F.col("age").desc()).rowsBetween(Window.unboundedPreceding, 0)))
    return t.select("age", "m", "q", "l", "d", "big_l", "big_t", F.try_divide(F.col("big_t"), F.col("l")).alias("e"))


def chain_ladder(df: DataFrame, origin: str, dev: str, claims: str) -> DataFrame:
    """Volume-weighted development factors, ultimates and reserves of an incremental triangle."""
    rows = collect_bounded(df.groupBy(F.col(origin).alias("o"), F.col(dev).cast("int").alias("j")).agg(F.sum(num(claims)).alias("c")), "triangle cells")
    os_, js = sorted({r["o"] for r in rows}), sorted({r["j"] for r in rows})
    inc = {(r["o"], r["j"]): r["c"] for r in rows}
    cum = {}
    for o in os_:
        run, seen = 0.0, [j for j in js if (o, j) in inc]
        for j in js:
            if seen and j <= seen[-1]:
                run += inc.get((o, j), 0.0)
                cum[(o, j)] = run
    f = {}
    for a, b in zip(js, js[1:]):
        both = [o for o in os_ if (o, a) in cum and (o, b) in cum]
        den = sum(cum[(o, a)] for o in both)
        f[a] = sum(cum[(o, b)] for o in both) / den if den else 1.0
    out = []
    for o in os_:
        last = max(j for j in js if (o, j) in cum)
        ult = cum[(o, last)]
        for a in js[js.index(last):-1]:
            ult *= f[a]
        out.append((int(o), int(last), cum[(o, last)], f.get(last, 1.0), ult, ult - cum[(o, last)]))
    return rows_frame(df.sparkSession, "origin bigint, last_dev bigint, latest double, next_factor double, ultimate double, ibnr double", out)


def weibull_life_analysis(df: DataFrame, life: str, event: str) -> DataFrame:
    """Censored Weibull against log-normal by AIC, B10/B50 life and mean life."""
    d = complete(df, [life, event]).where(F.col(life) > 0)
    k, sc, ll, r = weibull_shape(d, life, F.col(event))
    lm = aft_fit(d, life, event, [], "lognormal")
    return one_row(df.sparkSession, failures=int(r), shape=k, scale=sc, aic_weibull=4 - 2 * ll, aic_lognormal=lm.aic, better="weibull" if 4 - 2 * ll <= lm.aic else "lognormal",
                   b10=sc * (-math.log(0.9)) ** (1 / k), b50=sc * math.log(2) ** (1 / k), mttf=sc * math.gamma(1 + 1 / k))


def reliability_growth(df: DataFrame, time: str, key: str | None = None, termination_time: float | None = None, projection: float = 1.5) -> DataFrame:
    """Crow-AMSAA power law per system on cumulative failure times."""
    need(df, time, key)
    k = F.col(key) if key else F.lit("all")
    d = df.select(k.alias("system"), num(time).alias("t")).where("t > 0")
    g = d.groupBy("system").agg(F.count(F.lit(1)).alias("n"), F.max("t").alias("last"), F.sum(F.log("t")).alias("sl")).where("n >= 3")
    tt = F.lit(float(termination_time)) if termination_time else F.col("last")
    n = F.col("n").cast("double")
    beta = F.try_divide(n if termination_time else n - 1, n * F.log(tt) - F.col("sl"))
    g = g.withColumn("beta", beta).withColumn("lam", n / F.pow(tt, F.col("beta")))
    mt = lambda x: 1 / (F.col("lam") * F.col("beta") * F.pow(x, F.col("beta") - 1))
    return g.select("system", "n", "beta", F.log("lam").alias("log_lambda"), (tt / n).alias("cumulative_mtbf"), mt(tt).alias("instantaneous_mtbf"), mt(tt * projection).alias("projected_mtbf"))


def accelerated_life_test(df: DataFrame, life: str, stress: str, use_stress: float, model: str = "arrhenius", event: str | None = None) -> DataFrame:
    """Log-linear Weibull life in 1/T or ln V, and the acceleration factor to use conditions."""
    d = complete(df, [life, stress] + ([event] if event else [])).where(F.col(life) > 0)
    s = fetch(d, lo=F.min(stress), hi=F.max(stress))
    refuse(s["lo"] == s["hi"], "one stress level only")
    add = 273.15 if model == "arrhenius" and s["hi"] < 200 else 0.0
    x = 1 / (F.col(stress) + add) if model == "arrhenius" else F.log(stress)
    e = d.select(F.col(life).alias("__t"), (F.col(event) if event else F.lit(1.0)).alias("__e"), x.alias("__x"))
    f = aft_fit(e, "__t", "__e", ["__x"], "weibull")
    b0, b1, ls = f.beta
    tr = (lambda v: 1 / (v + add)) if model == "arrhenius" else math.log
    return one_row(df.sparkSession, n=int(f.n), intercept=float(b0), slope=float(b1), shape=float(math.exp(-ls)), loglik=f.ll, slope_se=float(f.se[1]),
                   activation_energy_ev=float(b1 * 8.617333262e-5) if model == "arrhenius" else float("nan"),
                   acceleration_factor=float(math.exp(b1 * (tr(use_stress) - tr(s["hi"])))), life_at_use=float(math.exp(b0 + b1 * tr(use_stress))))
