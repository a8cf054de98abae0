"""Abnormal returns around events, set-based over all events and assets; a failed cell has a status, not an exception."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import StudyConfig

ESTIMATION, EVENT_WINDOW, OK = "insufficient_estimation", "insufficient_event_window", "ok"


def window_rows(rets: DataFrame, events: DataFrame, cfg: StudyConfig, low: int | None = None, high: int | None = None) -> DataFrame:
    """Returns joined to every event whose estimation or event window holds their day, with ``in_est`` and ``in_event``.

    The estimation window ends ``gap_days`` + 1 before the event (or before ``low`` if the window asked for lies before
    the event) and is ``estimation_days`` + 1 days long. Windows are exploded to days, so the join is by date.
    """
    low = cfg.event_from if low is None else low
    high = cfg.event_to if high is None else high
    base = F.date_add("date", low) if high < 0 else F.col("date")
    spans = events.select("event_id", "type", F.col("date").alias("event_date"), F.date_sub(base, cfg.gap_days + 1).alias("est_end"), F.date_add("date", low).alias("ev_start"), F.date_add("date", high).alias("ev_end"))
    spans = spans.withColumn("est_start", F.date_sub("est_end", cfg.estimation_days))
    days = spans.select("event_id", "type", "event_date", "est_end", "ev_start", F.explode(F.sequence("est_start", F.greatest("est_end", "ev_end"))).alias("date"), "ev_end")
    rows = rets.where("ret is not null").join(days, "date")
    return rows.withColumns({"in_est": F.col("date") <= F.col("est_end"), "in_event": F.col("date").between(F.col("ev_start"), F.col("ev_end"))}).where("in_est or in_event")


def cells(rets: DataFrame, events: DataFrame) -> DataFrame:
    """Every event with every asset."""
    return events.select("event_id", "type", F.col("date").alias("event_date")).crossJoin(rets.select("asset").distinct())


def _status(cfg: StudyConfig, est: str = "est_n", ev: str = "event_n"):
    return F.when(F.coalesce(F.col(est), F.lit(0)) < cfg.estimation_min, ESTIMATION).when(F.coalesce(F.col(ev), F.lit(0)) < cfg.event_min, EVENT_WINDOW).otherwise(OK)


def constant_mean(rets: DataFrame, events: DataFrame, cfg: StudyConfig, low: int | None = None, high: int | None = None) -> DataFrame:
    """event_id, type, event_date, asset, est_n, event_n, est_mean, est_sd, car, sar, status.

    CAR is the sum of returns less the estimation mean; SAR divides it by the sample sd times the root of the days. Both
    are null unless the status is ok; a zero sd gives a null SAR.
    """
    rows = window_rows(rets, events, cfg, low, high)
    by = rows.groupBy("event_id", "asset").agg(
        F.count_if("in_est").alias("est_n"),
        F.count_if("in_event").alias("event_n"),
        F.avg(F.when(F.col("in_est"), F.col("ret"))).alias("est_mean"),
        F.stddev_samp(F.when(F.col("in_est"), F.col("ret"))).alias("est_sd"),
        F.sum(F.when(F.col("in_event"), F.col("ret"))).alias("event_sum"),
    )
    out = cells(rets, events).join(by, ["event_id", "asset"], "left").withColumns({"est_n": F.coalesce("est_n", F.lit(0)), "event_n": F.coalesce("event_n", F.lit(0))})
    out = out.withColumn("status", _status(cfg))
    car = F.when(F.col("status") == OK, F.col("event_sum") - F.col("event_n") * F.col("est_mean"))
    return out.withColumn("car", car).select(
        "event_id", "type", "event_date", "asset", "est_n", "event_n", "est_mean", "est_sd", "car", F.try_divide(F.col("car"), F.col("est_sd") * F.sqrt(F.col("event_n").cast("double"))).alias("sar"), "status"
    )


def abnormal_days(rets: DataFrame, events: DataFrame, cfg: StudyConfig) -> DataFrame:
    """event_id, asset, date, ar, est_n, est_sd on event-window days of cells whose status is ok."""
    told = constant_mean(rets, events, cfg).where(F.col("status") == OK).select("event_id", "asset", "est_n", "est_mean", "est_sd")
    days = window_rows(rets, events, cfg).where("in_event")
    return days.join(told, ["event_id", "asset"]).select("event_id", "type", "asset", "date", (F.col("ret") - F.col("est_mean")).alias("ar"), "est_n", "est_sd")


def market_model(rets: DataFrame, market: DataFrame, events: DataFrame, cfg: StudyConfig, proxy: str | None = None) -> DataFrame:
    """event_id, type, event_date, asset, est_n, event_n, alpha, beta, est_sd, car, sar, status.

    ``market``: (date, mkt), or (asset, date, mkt) for a market of its own for each asset. Only days with both returns
    count. The sd is that of the residuals, from a second pass. ``proxy``: an asset that takes the constant-mean model.
    """
    keys = ["asset", "date"] if "asset" in market.columns else ["date"]
    pairs = rets.where("ret is not null").join(market.where("mkt is not null"), keys)
    if proxy is not None:
        pairs = pairs.where(F.col("asset") != proxy)
    rows = window_rows(pairs, events, cfg)
    y, x = F.when(F.col("in_est"), F.col("ret")), F.when(F.col("in_est"), F.col("mkt"))
    line = rows.groupBy("event_id", "asset").agg(F.count_if("in_est").alias("est_n"), F.count_if("in_event").alias("event_n"), F.regr_slope(y, x).alias("beta"), F.regr_intercept(y, x).alias("alpha"))
    residual = F.col("ret") - F.col("alpha") - F.col("beta") * F.col("mkt")
    second = rows.join(line, ["event_id", "asset"]).groupBy("event_id", "asset", "est_n", "event_n", "alpha", "beta").agg(
        F.stddev_samp(F.when(F.col("in_est"), residual)).alias("est_sd"), F.sum(F.when(F.col("in_event"), residual)).alias("event_sum")
    )
    names = ["event_id", "type", "event_date", "asset", "est_n", "event_n", "alpha", "beta", "est_sd", "car", "sar", "status"]
    grid = cells(pairs, events) if proxy is None else cells(rets.where(F.col("asset") != proxy), events)
    out = grid.join(second, ["event_id", "asset"], "left").withColumns({"est_n": F.coalesce("est_n", F.lit(0)), "event_n": F.coalesce("event_n", F.lit(0))}).withColumn("status", _status(cfg))
    out = out.withColumn("car", F.when(F.col("status") == OK, F.col("event_sum")))
    out = out.withColumn("sar", F.try_divide(F.col("car"), F.col("est_sd") * F.sqrt(F.col("event_n").cast("double")))).select(*names)
    if proxy is None:
        return out
    own = constant_mean(rets.where(F.col("asset") == proxy), events, cfg).withColumnRenamed("est_mean", "alpha").withColumn("beta", F.lit(None).cast("double"))
    return out.unionByName(own.select(*names))


def market_without(rets: DataFrame, complete: bool = True) -> DataFrame:
    """(asset, date, mkt): the mean return of all other assets; with ``complete`` only on days when all others have one."""
    days = rets.where("ret is not null").groupBy("date").agg(F.sum("ret").alias("s"), F.count("ret").alias("k"))
    n = rets.agg(F.count_distinct("asset").alias("n"))
    grid = rets.select("asset").distinct().crossJoin(days).join(rets.select("asset", "date", "ret"), ["asset", "date"], "left").crossJoin(F.broadcast(n))
    others = F.col("k") - F.when(F.col("ret").isNotNull(), 1).otherwise(0)
    rows = grid.where(others > 0) if not complete else grid.where(others == F.col("n") - 1)
    return rows.select("asset", "date", F.try_divide(F.col("s") - F.coalesce("ret", F.lit(0.0)), others).alias("mkt"))


def event_level(cars: DataFrame, complete_days: int | None = None) -> DataFrame:
    """event_id, type, mean_car, n_assets: the mean over usable assets, one value for each event."""
    usable = cars.where(F.col("status") == OK)
    if complete_days is not None:
        usable = usable.where(F.col("event_n") == complete_days)
    return usable.groupBy("event_id", "type").agg(F.avg("car").alias("mean_car"), F.count(F.lit(1)).alias("n_assets"))


def coverage(cars: DataFrame, complete_days: int | None = None) -> DataFrame:
    """One row: cells in total, usable, missing, by reason, and the missing ones as event:asset;..."""
    short = F.lit(False) if complete_days is None else (F.col("status") == OK) & (F.col("event_n") != complete_days)
    why = F.when(F.col("status") == ESTIMATION, "estimation").when((F.col("status") == EVENT_WINDOW) | short, "event_window")
    rows = cars.withColumn("why", why)
    lost = F.when(F.col("why").isNotNull(), F.struct("event_id", "asset"))
    return rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("why").isNull()).alias("usable"),
        F.count_if(F.col("why").isNotNull()).alias("missing"),
        F.count_if(F.col("why") == "estimation").alias("missing_estimation"),
        F.count_if(F.col("why") == "event_window").alias("missing_event_window"),
        F.array_join(F.transform(F.sort_array(F.collect_list(lost)), lambda x: F.concat(x.event_id.cast("string"), F.lit(":"), x.asset)), ";").alias("missing_cells"),
    )


def difference_by_type(levels: DataFrame, value: str = "mean_car") -> DataFrame:
    """One row: means, variances and counts of both types and the difference of the means."""
    a, b = F.when(F.col("type") == "Infrastructure", F.col(value)), F.when(F.col("type") == "Regulatory", F.col(value))
    made = levels.agg(*(f(x).alias(f"{k}_{s}") for s, x in (("infra", a), ("reg", b)) for k, f in (("mean", F.avg), ("var", F.var_samp), ("n", F.count))))
    return made.withColumn("diff", F.col("mean_infra") - F.col("mean_reg"))


def abnormal_variance(rets: DataFrame, events: DataFrame, before: int = 3, after: int = 3) -> DataFrame:
    """event_id, type, asset, excess: mean squared return in the window less the asset's mean square."""
    days = events.select("event_id", "type", F.explode(F.sequence(F.date_sub("date", before), F.date_add("date", after))).alias("date"))
    near = rets.join(days, "date").groupBy("event_id", "type", "asset").agg(F.avg(F.col("ret") * F.col("ret")).alias("near"))
    base = rets.groupBy("asset").agg(F.avg(F.col("ret") * F.col("ret")).alias("base"))
    return near.join(base, "asset").select("event_id", "type", "asset", (F.col("near") - F.col("base")).alias("excess"))


def difference_in_differences(rows: DataFrame, value: str) -> DataFrame:
    """One row from (type, post, value): the DiD with independent population standard errors; df is the count less 4."""
    cell = {f"{k}_{p}": F.when((F.col("type") == t) & (F.col("post") == (p == "post")), F.col(value)) for k, t in (("infra", "Infrastructure"), ("reg", "Regulatory")) for p in ("pre", "post")}
    out = rows.agg(*(f(x).alias(f"{n}_{k}") for k, x in cell.items() for n, f in (("m", F.avg), ("s", F.stddev_pop), ("n", F.count))))
    did = (F.col("m_infra_post") - F.col("m_infra_pre")) - (F.col("m_reg_post") - F.col("m_reg_pre"))
    se = F.sqrt(sum(F.col(f"s_{k}") * F.col(f"s_{k}") / F.nullif(F.col(f"n_{k}"), F.lit(0)) for k in cell))
    df = sum(F.col(f"n_{k}") for k in cell) - 4
    return out.select(did.alias("did"), se.alias("se"), F.when(se > 0, did / se).otherwise(0.0).alias("t"), df.alias("df"), *(F.col(f"m_{k}").alias(f"mean_{k}") for k in cell))


def kolari_pynnonen(ars: DataFrame, least: int = 5) -> DataFrame:
    """One row for each event: the t adjusted for cross-correlation, on the days that all its assets have.

    event_id, n_assets, n_days, rbar, car, t_unadjusted, t_kp, df. With one asset: its own t (car is null, df is days
    less 1). Events with fewer than ``least`` common days are left out.
    """
    assets = ars.groupBy("event_id").agg(F.count_distinct("asset").alias("n_assets"))
    days = ars.groupBy("event_id", "date").agg(F.count(F.lit(1)).alias("k"), F.avg("ar").alias("aar"))
    common = days.join(assets, "event_id").where("k = n_assets")
    totals = common.groupBy("event_id", "n_assets").agg(F.count(F.lit(1)).alias("n_days"), F.sum("aar").alias("car"))
    kept = ars.join(common.select("event_id", "date"), ["event_id", "date"])
    left, right = kept.select("event_id", "date", "asset", F.col("ar").alias("x")), kept.select("event_id", "date", F.col("asset").alias("other"), F.col("ar").alias("y"))
    corr = left.join(right, ["event_id", "date"]).where("asset <> other").groupBy("event_id", "asset", "other").agg(F.corr("x", "y").alias("c"))
    rbar = corr.groupBy("event_id").agg(F.avg("c").alias("rbar"))
    scale = ars.groupBy("event_id", "asset").agg(F.first("est_sd").alias("sd"), F.first("est_n").alias("n")).groupBy("event_id").agg(F.avg("sd").alias("sd"), F.sum("n").alias("n"))
    out = totals.join(scale, "event_id").join(rbar, "event_id", "left")
    one = F.col("n_assets") == 1
    plain = F.try_divide(F.col("car"), F.col("sd") * F.sqrt(F.col("n_days").cast("double")) / F.sqrt(F.col("n_assets").cast("double")))
    grown = 1 + (F.col("n_assets") - 1) * F.coalesce("rbar", F.lit(0.0))
    out = out.withColumns({"t_unadjusted": plain, "t_kp": F.when(one | (grown <= 0), plain).otherwise(plain / F.sqrt(F.greatest(grown, F.lit(1e-300)))), "df": F.when(one, F.col("n_days") - 1).otherwise(F.col("n") - F.col("n_assets"))})
    return out.where(one | (F.col("n_days") >= least)).select("event_id", "n_assets", "n_days", F.when(one, 0.0).otherwise(F.col("rbar")).alias("rbar"), F.when(~one, F.col("car")).alias("car"), "t_unadjusted", "t_kp", "df")
