"""Statistics and tests in closed form, as aggregations; tails come from ``functions.distributions`` where asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.timeseries import by_asset, lags


def moments(rows: DataFrame, column: str = "ret", keys: tuple[str, ...] = ("asset",)) -> DataFrame:
    """n, mean, sd, bias-corrected skewness and excess kurtosis, annualised volatility; null where n is too small."""
    out = rows.groupBy(*keys).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("sd"), F.skewness(column).alias("g1"), F.kurtosis(column).alias("g2"))
    n = F.col("n").cast("double")
    skew = F.when(n > 2, F.sqrt(n * (n - 1)) / (n - 2) * F.col("g1"))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6))
    return out.select(*keys, "n", "mean", "sd", skew.alias("skew"), kurt.alias("kurtosis"), (F.col("sd") * F.sqrt(F.lit(252.0))).alias("annual_vol"))


def coefficient_summary(rows: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Means, medians, their ratio, Welch t and Cohen's d of two coefficients over assets; a zero base gives null."""
    out = rows.groupBy(key).agg(*(f(c).alias(f"{k}_{s}") for s, c in (("a", a), ("b", b)) for k, f in (("mean", F.avg), ("median", F.median), ("var", F.var_samp), ("n", F.count))))
    d = F.col("mean_a") - F.col("mean_b")
    return out.withColumns({"multiplier": F.try_divide("mean_a", "mean_b"), "welch_t": F.try_divide(d, F.sqrt(F.try_divide("var_a", "n_a") + F.try_divide("var_b", "n_b"))), "cohens_d": F.try_divide(d, F.sqrt((F.col("var_a") + F.col("var_b")) / 2))})


def welch(levels: DataFrame, value: str, group: str = "type", first: str = "Infrastructure", second: str = "Regulatory") -> DataFrame:
    """One row: means, difference, standard error, t, Satterthwaite df, pooled sd, Cohen's d, minimum detectable effect."""
    a, b = F.when(F.col(group) == first, F.col(value)), F.when(F.col(group) == second, F.col(value))
    out = levels.agg(*(f(x).alias(f"{k}{s}") for s, x in ((1, a), (2, b)) for k, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))))
    q1, q2 = F.try_divide("v1", "n1"), F.try_divide("v2", "n2")
    se = F.sqrt(q1 + q2)
    sp = F.sqrt(F.try_divide((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2"), F.col("n1") + F.col("n2") - 2))
    need = F.lit(1.959963984540054 + 0.8416212335729143)  # normal quantiles of 0.975 and 0.8
    d_mde = need * F.sqrt(F.try_divide(F.lit(1.0), "n1") + F.try_divide(F.lit(1.0), "n2"))
    return out.select(
        F.col("m1").alias("mean_1"), F.col("m2").alias("mean_2"), (F.col("m1") - F.col("m2")).alias("diff"), se.alias("se"), F.try_divide(F.col("m1") - F.col("m2"), se).alias("t"),
        F.try_divide((q1 + q2) * (q1 + q2), F.try_divide(q1 * q1, F.col("n1") - 1) + F.try_divide(q2 * q2, F.col("n2") - 1)).alias("df"), sp.alias("pooled_sd"), F.try_divide(F.col("m1") - F.col("m2"), sp).alias("cohens_d"), d_mde.alias("d_mde"), (d_mde * sp).alias("mde"),
    )


def mann_whitney(rows: DataFrame, value: str, group: str = "type", first: str = "Infrastructure", ranges: int = 64) -> DataFrame:
    """One row: U of the first group, counts, the normal z with ties and continuity corrected; null values are left out.

    Ranks come from counts of distinct values: each of about ``ranges`` ranges of values is counted on its own, and a
    value's rank is what lies in lower ranges, what lies lower in its own, and half of what it shares.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("t"), F.count_if(F.col(group) == first).alias("t1"))
    edges = rows.agg(F.percentile_approx(value, [k / ranges for k in range(1, ranges)], 1000)).first()[0] or []  # at most ``ranges`` numbers
    within = sum(((F.col("v") > float(e)).cast("int") for e in sorted(set(edges))), F.lit(0))
    counted = counted.withColumn("k", within)
    lower = counted.groupBy("k").agg(F.sum("t").alias("m")).withColumn("below", F.coalesce(F.sum("m").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    upto = F.sum("t").over(Window.partitionBy("k").orderBy("v"))
    ranked = counted.withColumn("upto", upto).join(F.broadcast(lower.select("k", "below")), "k")
    rank = F.col("below") + F.col("upto") - (F.col("t") - 1) / 2.0
    t, t1 = F.col("t").cast("double"), F.col("t1")
    out = ranked.agg(F.sum(t1 * rank).alias("r"), F.coalesce(F.sum(t1), F.lit(0)).alias("n1"), F.coalesce(F.sum(F.col("t") - t1), F.lit(0)).alias("n2"), F.sum(t * (t * t - 1)).alias("tie"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n, u = n1 + n2, F.col("r") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("tie"), n * (n - 1))))
    return out.select(u.alias("u"), "n1", "n2", F.try_divide(F.greatest(F.abs(u - n1 * n2 / 2) - 0.5, F.lit(0.0)), sd).alias("z"))


def cluster_slope(rows: DataFrame, value: str, flag: Column, cluster: str) -> DataFrame:
    """One row: OLS of a value on a 0/1 regressor with a cluster-robust sandwich (factor G/(G-1) (N-1)/(N-2))."""
    data = rows.select(F.col(value).alias("y"), flag.cast("double").alias("x"), F.col(cluster).alias("c")).where("y is not null and x is not null")
    mean = data.agg(F.avg("x").alias("xm"), F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"), F.count(F.lit(1)).alias("n"), F.regr_sxx("y", "x").alias("sxx"))
    scored = data.crossJoin(F.broadcast(mean)).withColumn("s", (F.col("x") - F.col("xm")) * (F.col("y") - F.col("a") - F.col("b") * F.col("x")))
    by = scored.groupBy("c").agg(F.sum("s").alias("s"))
    meat = by.agg(F.sum(F.col("s") * F.col("s")).alias("meat"), F.count(F.lit(1)).alias("g"))
    g, n = F.col("g").cast("double"), F.col("n").cast("double")
    return mean.crossJoin(meat).select(F.col("b").alias("slope"), F.sqrt(F.try_divide(F.col("meat") * g * (n - 1), (g - 1) * (n - 2))).alias("root"), "sxx", "g", "n").select("slope", F.try_divide("root", "sxx").alias("se"), F.try_divide(F.col("slope"), F.try_divide("root", "sxx")).alias("t"), F.col("g").alias("n_clusters"), F.col("n").alias("n_obs"))


def correlations(panel: DataFrame, value: str = "ret") -> DataFrame:
    """(a, b, corr, cov, n) of all pairs of assets on complete days."""
    from tidemark.operators.calendar import complete_cases

    rows = complete_cases(panel, value)
    left = rows.select("date", F.col("asset").alias("a"), F.col(value).alias("x"))
    right = rows.select("date", F.col("asset").alias("b"), F.col(value).alias("y"))
    return left.join(right, "date").groupBy("a", "b").agg(F.corr("x", "y").alias("corr"), F.covar_samp("x", "y").alias("cov"), F.count(F.lit(1)).alias("n"))


def mean_off_diagonal(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").agg(F.avg("corr").alias("rbar"), F.max(F.abs("corr")).alias("highest"))


def design_effect(differences: DataFrame, rbar: DataFrame, value: str) -> DataFrame:
    """One row: mean paired difference, its plain t, DEFF = 1 + (N-1) rbar, the deflated t, effective N and df.

    A DEFF that is not positive (beyond rounding) leaves the deflated numbers null.
    """
    out = differences.agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n")).crossJoin(rbar)
    n = F.col("n").cast("double")
    t = F.try_divide(F.col("mean"), F.try_divide(F.col("sd"), F.sqrt(n)))
    deff = 1 + (n - 1) * F.col("rbar")
    some = F.when(deff > 1e-9, deff)
    return out.select("mean", "sd", "n", "rbar", t.alias("t_naive"), deff.alias("deff"), (t / F.sqrt(some)).alias("t_deff"), (n / some).alias("n_eff"), ((n - 1) / some).alias("df_eff"))


def correlation_weighted_variance(errors: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row from (asset, se): sum over pairs of correlation times both errors, over the squared number of assets."""
    a, b = errors.select(F.col("asset").alias("a"), F.col("se").alias("sa")), errors.select(F.col("asset").alias("b"), F.col("se").alias("sb"))
    return pairs.join(a, "a").join(b, "b").agg(F.try_divide(F.sum(F.col("corr") * F.col("sa") * F.col("sb")), F.count_distinct("a") * F.count_distinct("a")).alias("var_mean"))


def two_proportions(rows: DataFrame, group: Column, success: Column) -> DataFrame:
    """One row: rates of both groups and the pooled z of their difference."""
    out = rows.agg(F.count_if(group).alias("n1"), F.count_if(~group).alias("n2"), F.count_if(group & success).alias("k1"), F.count_if(~group & success).alias("k2"))
    p1, p2 = F.try_divide("k1", "n1"), F.try_divide("k2", "n2")
    p = F.try_divide(F.col("k1") + F.col("k2"), F.col("n1") + F.col("n2"))
    return out.select("n1", "n2", "k1", "k2", p1.alias("rate_1"), p2.alias("rate_2"), F.try_divide(p1 - p2, F.sqrt(p * (1 - p) * (F.try_divide(F.lit(1.0), "n1") + F.try_divide(F.lit(1.0), "n2")))).alias("z"))


def one_sample(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    out = rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"))
    return out.withColumn("t", F.try_divide(F.col("mean"), F.try_divide(F.col("sd"), F.sqrt(F.col("n").cast("double")))))


def ljung_box(rows: DataFrame, column: str, upto: list[int], keys: tuple[str, ...] = ("asset",)) -> DataFrame:
    """(keys, lag, n, q) for each lag in ``upto``: autocorrelations about the mean of the whole series."""
    most = max(upto)
    mean = F.avg(column).over(Window.partitionBy(*keys))
    centred = rows.where(F.col(column).isNotNull()).withColumn("x", F.col(column) - mean)
    data = lags(centred.select(*keys, "date", "x"), "x", most, keys=keys)
    sums = data.groupBy(*keys).agg(F.count("x").alias("n"), F.sum(F.col("x") * F.col("x")).alias("s0"), *(F.sum(F.col("x") * F.col(f"x_l{k}")).alias(f"s{k}") for k in range(1, most + 1)))
    term = lambda k: F.try_divide(F.col(f"s{k}"), "s0") * F.try_divide(F.col(f"s{k}"), "s0") / (F.col("n") - k)
    q = [F.struct(F.lit(m).alias("lag"), (F.col("n") * (F.col("n") + 2) * sum((term(k) for k in range(2, m + 1)), term(1))).alias("q")) for m in upto]
    return sums.select(*keys, "n", F.explode(F.array(*q)).alias("r")).select(*keys, "r.lag", "n", "r.q")


def jarque_bera(rows: DataFrame, column: str, keys: tuple[str, ...] = ("asset",)) -> DataFrame:
    out = rows.groupBy(*keys).agg(F.count(column).alias("n"), F.skewness(column).alias("skew"), F.kurtosis(column).alias("kurt"))
    return out.withColumn("jb", F.col("n") / 6.0 * (F.col("skew") * F.col("skew") + F.col("kurt") * F.col("kurt") / 4.0))


def benjamini_hochberg(rows: DataFrame, p: str, key: list[str], family: list[str], levels: tuple[float, ...] = (0.05, 0.10)) -> DataFrame:
    """Adds ``p_adjusted`` and a flag for each level; null p-values are outside the family and never rejected."""
    own = [*family, F.col(p).isNull()]
    up = Window.partitionBy(*own).orderBy(p, *key)
    all_ = Window.partitionBy(*own)
    ranked = rows.withColumn("_k", F.row_number().over(up)).withColumn("_m", F.count(F.lit(1)).over(all_))
    down = Window.partitionBy(*own).orderBy(F.col("_k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = ranked.withColumn("p_adjusted", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_k")).over(down))))
    for q in levels:
        edge = F.max(F.when(F.col(p) <= F.lit(q) * F.col("_k") / F.col("_m"), F.col("_k"))).over(all_)
        out = out.withColumn(f"reject_{round(q * 100):03d}", F.col(p).isNotNull() & (F.col("_k") <= F.coalesce(edge, F.lit(0))))
    return out.drop("_k", "_m")


def information_criteria(rows: DataFrame) -> DataFrame:
    """Adds k (5, 6 or 6 plus the exogenous terms; the profiled mean counts), AIC and BIC to (model, log_lik, n_obs, n_exog)."""
    k = F.when(F.col("model") == "GARCH", 5).when(F.col("model") == "GJR", 6).otherwise(6 + F.col("n_exog"))
    return rows.withColumn("k", k).withColumns({"aic": 2 * F.col("k") - 2 * F.col("log_lik"), "bic": F.col("k") * F.ln("n_obs") - 2 * F.col("log_lik")})


def best_model(rows: DataFrame, keys: list[str], name: str, score: str) -> DataFrame:
    """The model of the least score in each group, and its margin to the second."""
    w = Window.partitionBy(*keys).orderBy(score, name)
    ranked = rows.withColumn("_k", F.row_number().over(w)).where("_k <= 2")
    return ranked.groupBy(*keys).agg(F.min_by(name, "_k").alias("winner"), F.min(score).alias("best"), F.when(F.count(F.lit(1)) > 1, F.max(score) - F.min(score)).alias("margin"))


def persistence(fits: DataFrame) -> DataFrame:
    """Adds persistence alpha + beta + |gamma|/2 and its working error from the squared errors, gamma's a quarter."""
    se = F.sqrt(F.col("se_alpha") * F.col("se_alpha") + F.col("se_beta") * F.col("se_beta") + F.col("se_gamma") * F.col("se_gamma") / 4)
    return fits.withColumns({"persistence": F.col("alpha") + F.col("beta") + F.abs("gamma") / 2, "persistence_se": se})


def ar1_filter(rows: DataFrame, column: str = "ret") -> DataFrame:
    """Adds ``residual``: what an AR(1) fitted by least squares to each asset leaves; the first row has none."""
    data = rows.withColumn("_l", F.lag(column).over(by_asset()))
    line = data.where("_l is not null").groupBy("asset").agg(F.regr_slope(column, "_l").alias("phi"), F.regr_intercept(column, "_l").alias("const"))
    return data.where("_l is not null").join(line, "asset").withColumn("residual", F.col(column) - F.col("const") - F.col("phi") * F.col("_l")).drop("_l")


def events_in_mean(rows: DataFrame, column: str = "ret") -> DataFrame:
    """Adds ``residual`` of least squares on a constant and two 0/1 columns that never overlap: group means.

    Where they do overlap, the 3 x 3 normal equations are solved in closed form.
    """
    d, r, y = F.col("d_infrastructure"), F.col("d_regulatory"), F.col(column)
    s = rows.groupBy("asset").agg(F.count(y).alias("n"), F.sum(d).alias("sd"), F.sum(r).alias("sr"), F.sum(d * d).alias("dd"), F.sum(r * r).alias("rr"), F.sum(d * r).alias("dr"), F.sum(y).alias("sy"), F.sum(d * y).alias("dy"), F.sum(r * y).alias("ry"))
    c = {k: F.col(k) for k in ("n", "sd", "sr", "dd", "rr", "dr", "sy", "dy", "ry")}
    a11, a12, a22 = c["dd"] - c["sd"] * c["sd"] / c["n"], c["dr"] - c["sd"] * c["sr"] / c["n"], c["rr"] - c["sr"] * c["sr"] / c["n"]
    b1, b2 = c["dy"] - c["sd"] * c["sy"] / c["n"], c["ry"] - c["sr"] * c["sy"] / c["n"]
    det = a11 * a22 - a12 * a12
    line = s.select("asset", F.coalesce(F.try_divide(b1 * a22 - b2 * a12, det), F.lit(0.0)).alias("b_infra"), F.coalesce(F.try_divide(b2 * a11 - b1 * a12, det), F.lit(0.0)).alias("b_reg"), "sy", "n", "sd", "sr")
    line = line.withColumn("const", (F.col("sy") - F.col("b_infra") * F.col("sd") - F.col("b_reg") * F.col("sr")) / F.col("n")).select("asset", "const", "b_infra", "b_reg")
    return rows.join(line, "asset").withColumn("residual", y - F.col("const") - F.col("b_infra") * d - F.col("b_reg") * r)


def collinear(rows: DataFrame, columns: list[str], limit: float = 0.95) -> DataFrame:
    """(asset, a, b, corr) for pairs of columns whose correlation exceeds the limit in size."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    out = rows.groupBy("asset").agg(*(F.corr(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)))
    made = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("corr")) for k, (a, b) in enumerate(pairs)))
    return out.select("asset", F.explode(made).alias("r")).select("asset", "r.*").where(F.abs("corr") > limit)


def contingency(rows: DataFrame, flag: str, value: str, keys: tuple[str, ...] = ("asset",)) -> DataFrame:
    """Counts of a 0/1 flag against above or not above the group's median, and the Yates chi-square of the table."""
    middle = rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.median(value).alias("_m"))
    data = rows.where(F.col(value).isNotNull()).join(middle, list(keys)).withColumn("_hi", F.col(value) > F.col("_m"))
    out = data.groupBy(*keys).agg(*(F.count_if((F.col(flag) == f) & (F.col("_hi") == h)).alias(f"n{f}{int(h)}") for f in (0, 1) for h in (False, True)))
    n00, n01, n10, n11 = (F.col(c).cast("double") for c in ("n00", "n01", "n10", "n11"))
    n = n00 + n01 + n10 + n11
    gap = F.abs(n00 * n11 - n01 * n10)
    chi = F.try_divide(n * F.pow(F.greatest(gap - n / 2, F.lit(0.0)), F.lit(2.0)), (n00 + n01) * (n10 + n11) * (n00 + n10) * (n01 + n11))
    return out.withColumn("chi2_yates", chi)


def draw_summary(draws: DataFrame, observed: float, column: str = "dbar", sums: tuple[str, ...] = ()) -> DataFrame:
    """One row: draws used, hits, add-one tails (one-sided and of sizes; null without draws), mean, sd, share dropped, sums."""
    x = F.col(column)
    tail = lambda hit: F.when(F.count(x) > 0, (F.count_if(hit) + 1) / (F.count(x) + 1))
    return draws.agg(
        F.count(x).alias("n_used"), F.count_if(x >= observed).alias("hits"), tail(x >= observed).alias("p_one"), tail(F.abs(x) >= abs(observed)).alias("p_abs"),
        F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.try_divide(F.count_if(x.isNull()), F.count(F.lit(1))).alias("share_dropped"),
        *(F.sum(c).alias(c) for c in sums),
    )


def rejection_rate(rows: DataFrame, reject: Column, *keys: str) -> DataFrame:
    out = rows.groupBy(*keys).agg(F.avg(reject.cast("double")).alias("size"), F.count(reject).alias("n"))
    return out.withColumn("se", F.sqrt(F.try_divide(F.col("size") * (1 - F.col("size")), F.col("n"))))


def exact_permutation(rows: DataFrame, value: str, group: str = "type", first: str = "Infrastructure", most: int = 20) -> DataFrame:
    """One row: the observed mean gap, all labelings with as many first labels, and how many have a gap at least as large.

    Labelings are the bit masks of n bits with k set; more than ``most`` observations are an error, because their
    labelings double with each.
    """
    data = rows.select(F.col(value).cast("double").alias("v"), (F.col(group) == first).cast("int").alias("f")).where("v is not null").limit(most + 1)
    packed = data.withColumn("i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("v", "f"))).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v", "f"))), lambda x: x.v).alias("v"), F.sum("f").alias("k"), F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("f")).alias("sf"))
    packed = packed.withColumn("n", F.when(F.col("n") <= most, F.col("n")).otherwise(F.raise_error(F.lit(f"more than {most} observations to label")).cast("long")))
    masks = packed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("shiftleft(1L, cast(n as int)) - 1"))).alias("mask")).where("bit_count(mask) = k")
    chosen = F.aggregate(F.zip_with("v", F.sequence(F.lit(0), F.col("n").cast("int") - 1), lambda v, i: F.when(F.call_function("getbit", F.col("mask"), i) == 1, v).otherwise(F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    gap = lambda s: F.try_divide(s, "k") - F.try_divide(F.col("s") - s, F.col("n") - F.col("k"))
    scored = masks.select(gap(F.col("sf")).alias("observed"), gap(chosen).alias("d"))
    out = scored.agg(F.first("observed").alias("diff"), F.count(F.lit(1)).alias("assignments"), F.count_if(F.abs("d") >= F.abs("observed") - 1e-12).alias("extreme"))
    return out.withColumn("p_two", F.try_divide("extreme", "assignments"))
