"""Labels, features, backtest, threshold curves and calibration: one labelled frame, everything else aggregates it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import calibrated_interval, safe_divide
from tidemark.operators.quality import realized_vol
from tidemark.operators.scans import chunk_order, in_chunks, percent_rank_bands, percentiles
from tidemark.operators.windows import asof_backward, asof_forward, ordered, prefix_stats


def cascade_labels(prices: DataFrame, rows: int = 30, move: float = 0.02, vol_p: float = 0.99, k: float = 3.0, least: int = 20) -> DataFrame:
    """def1 large move, def2 volatility in its top percent, def3 move of k deviations; any and strict combinations."""
    r = realized_vol(prices, rows)
    ret = r.withColumn("ret30", F.when(F.col("mark_price") > 0, F.lead("mark_price", rows).over(ordered()) / F.col("mark_price") - 1.0))
    limit = percentiles(ret.filter(F.col("cnt") >= least), "rv", (vol_p,), "symbol").select("symbol", F.col("q")[0].alias("rv_limit"))
    j = ret.join(limit, "symbol", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    d1 = yes(F.abs("ret30") >= move)
    d2 = yes((F.col("cnt") >= least) & (F.col("rv") >= F.col("rv_limit")))
    d3 = yes((F.col("cnt") >= least) & (F.abs("ret30") >= k * F.col("rv") * (rows**0.5)))
    return j.select("symbol", "ts", "mark_price", "ret30", "rv", "cnt", d1.alias("def1"), d2.alias("def2"), d3.alias("def3"), (d1 | d2 | d3).alias("any_label"), (d1 & (d2 | d3)).alias("strict_label"))


def label_counts(labels: DataFrame) -> DataFrame:
    names = ("def1", "def2", "def3", "any_label", "strict_label")
    return labels.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(f"n_{c}") for c in names], *[F.avg(F.col(c).cast("double")).alias(f"rate_{c}") for c in names])


def cascade_starts(labels: DataFrame, minutes: int = 30, label: str = "def1") -> DataFrame:
    """Labelled rows with no other labelled row in the ``minutes`` before."""
    on = labels.filter(label)
    before = F.lag("ts").over(ordered())
    return on.filter("true").withColumn("_b", before).filter(F.col("_b").isNull() | (F.unix_seconds("ts") - F.unix_seconds("_b") > minutes * 60)).drop("_b")


def hourly_events(labels: DataFrame, label: str = "def1") -> DataFrame:
    """Per hour with a labelled minute: the largest absolute move and its direction."""
    on = labels.filter(label)
    out = on.groupBy("symbol", F.date_trunc("hour", "ts").alias("hr")).agg(F.max(F.abs("ret30")).alias("move"), F.max_by("ret30", F.struct(F.abs("ret30"), -F.unix_millis("ts"))).alias("_r"))
    return out.select("symbol", "hr", "move", F.when(F.col("_r") > 0, "up").otherwise("down").alias("direction"))


def ret_zscore(prices: DataFrame, rows: int = 1440, least: int = 60) -> DataFrame:
    """ret_z: (abs return - mean) / deviation over the ``rows`` returns before the current one; 0 under ``least``."""
    w = chunk_order()
    before = F.lag("mark_price").over(w)
    r = in_chunks(prices, 1).withColumn("abs_ret", F.abs(F.when(before > 0, F.ln(F.col("mark_price") / before)))).filter("_mine").drop("_chunk", "_mine")
    s = prefix_stats(r, "abs_ret", rows, include_current=False, position="_n")
    z = (F.col("abs_ret") - F.col("w_mean")) / F.when(F.col("w_std") > 1e-15, F.col("w_std"))
    return s.select("symbol", "ts", "mark_price", "abs_ret", F.col("w_n").alias("obs"), F.when(F.col("w_n") >= least, F.coalesce(z, F.lit(0.0))).otherwise(0.0).alias("ret_z"))


def oi_zscore(oi: DataFrame, rows: int = 288) -> DataFrame:
    s = prefix_stats(oi, "open_interest_usd", rows, include_current=False)
    z = (F.col("open_interest_usd") - F.col("w_mean")) / F.when(F.col("w_std") > 0, F.col("w_std"))
    return s.select("symbol", "ts", F.coalesce(z, F.lit(0.0)).alias("oi_z"))


def vol_tercile(rv: DataFrame, value: str = "rv") -> DataFrame:
    """tercile 1 to 3 by percent rank within the symbol, nulls ranked last."""
    return percent_rank_bands(rv, value, (0.333, 0.667), name="tercile")


def feature_matrix(prices: DataFrame, oi: DataFrame, funding: DataFrame, ret_rows: int = 1440, oi_rows: int = 288, rv_rows: int = 30, warm: int = 1440) -> DataFrame:
    """ret_z, tercile, oi_z, funding and its regime, risk_score (0 to 100) and whether the row is warm."""
    base = ret_zscore(prices, ret_rows)
    vol = vol_tercile(realized_vol(prices, rv_rows)).select("symbol", "ts", "rv", "tercile")
    j = base.join(vol, ["symbol", "ts"])
    j = asof_backward(j, oi_zscore(oi, oi_rows), "oi_z")
    j = asof_backward(j, funding, "funding_rate", right_ts="funding_time")
    rate = F.coalesce("funding_rate", F.lit(0.0))
    score = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.rint(F.greatest(F.lit(0.0), F.col("ret_z")) * 20.0))).cast("int")
    return j.select("symbol", "ts", "mark_price", "obs", "ret_z", "rv", "tercile", F.coalesce("oi_z", F.lit(0.0)).alias("oi_z"), rate.alias("funding_rate"), F.when(rate > 1e-4, 1).when(rate < -1e-4, -1).otherwise(0).alias("funding_regime"), score.alias("risk_score"), (F.col("obs") >= warm).alias("warm"))


def cascade_in_horizon(scores: DataFrame, cascades: DataFrame, minutes: int = 60, score_ts: str = "time", start: str = "start_time") -> DataFrame:
    """Adds next_start, actual (a cascade starts in [t, t + horizon], both inclusive) and lead_min."""
    c = cascades.select("symbol", F.col(start).alias("_t")).withColumn("_v", F.col("_t"))
    j = asof_forward(scores, c, "_v", left_ts=score_ts, right_ts="_t", name="next_start")
    ahead = F.unix_millis("next_start") - F.unix_millis(score_ts)
    near = F.unix_micros("next_start") - F.unix_micros(score_ts) <= minutes * 60_000_000
    return j.withColumn("actual", F.coalesce(near, F.lit(False))).withColumn("lead_min", F.when(F.col("actual"), ahead / 60_000.0))


def confusion(labelled: DataFrame, predicted: Column, *keys: str, lead: str | None = "lead_min") -> DataFrame:
    """tp, fp, tn, fn, precision, recall, f1, fpr, avg_lead and the F1 of a random predictor of the same rate."""
    p, a = predicted, F.col("actual")
    out = labelled.groupBy(*keys).agg(
        F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & ~a).alias("tn"), F.count_if(~p & a).alias("fn"), *([F.coalesce(F.avg(F.when(p & a, F.col(lead))), F.lit(0.0)).alias("avg_lead")] if lead else [])
    )
    return with_rates(out)


def with_rates(counts: DataFrame) -> DataFrame:
    c = F.col
    pr, re = safe_divide(c("tp"), c("tp") + c("fp")), safe_divide(c("tp"), c("tp") + c("fn"))
    n = c("tp") + c("fp") + c("tn") + c("fn")
    rate, base = safe_divide(c("tp") + c("fp"), n), safe_divide(c("tp") + c("fn"), n)
    return counts.select(*counts.columns, pr.alias("precision"), re.alias("recall"), safe_divide(2 * pr * re, pr + re).alias("f1"), safe_divide(c("fp"), c("fp") + c("tn")).alias("fpr"), safe_divide(2 * rate * base, rate + base).alias("random_f1"))


def backtest(scores: DataFrame, cascades: DataFrame, score_at: int = 60, confidence_at: float = 0.0, minutes: int = 60) -> DataFrame:
    labelled = cascade_in_horizon(scores, cascades, minutes)
    return confusion(labelled, (F.col("risk_score") >= score_at) & (F.col("confidence") >= confidence_at), "symbol")


def backtest_micro(per_symbol: DataFrame) -> DataFrame:
    """Counts summed over symbols; the lead weighted by true positives where it is above 0."""
    some = F.when(F.col("avg_lead") > 0, F.col("tp"))
    out = per_symbol.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn")], F.coalesce(F.sum(some * F.col("avg_lead")) / F.nullif(F.sum(some), F.lit(0)), F.lit(0.0)).alias("avg_lead"))
    return with_rates(out)


def sweep_thresholds(labelled: DataFrame, grid: DataFrame) -> DataFrame:
    """``grid(score_at, confidence_at)`` against one labelled frame, first shrunk to (score, confidence, actual) counts. The grid is a parameter and goes into the plan."""
    counts = labelled.groupBy("risk_score", "confidence", "actual").agg(F.count(F.lit(1)).alias("n"))
    points = [F.struct(F.lit(r.score_at).alias("score_at"), F.lit(r.confidence_at).alias("confidence_at")) for r in grid.select("score_at", "confidence_at").distinct().collect()]
    x = counts.select("*", F.explode(F.array(*points)).alias("_g")).select("*", "_g.*").drop("_g").withColumn("p", (F.col("risk_score") >= F.col("score_at")) & (F.col("confidence") >= F.col("confidence_at")))
    total = lambda on, name: F.coalesce(F.sum(F.when(on, F.col("n"))), F.lit(0)).alias(name)
    p, a = F.col("p"), F.col("actual")
    return with_rates(x.groupBy("score_at", "confidence_at").agg(total(p & a, "tp"), total(p & ~a, "fp"), total(~p & ~a, "tn"), total(~p & a, "fn")))


def pr_curve(labelled: DataFrame, *keys: str, step: int = 5) -> DataFrame:
    """Metrics at thresholds 0, step, ... 100 from the score histogram: no cross product with the rows."""
    hist = labelled.groupBy(*keys, "risk_score").agg(F.count_if("actual").alias("pos"), F.count_if(~F.col("actual")).alias("neg"))
    at = F.explode(F.sequence(F.lit(0), F.lit(100), F.lit(step))).alias("threshold")
    x = hist.select("*", at)
    over = F.col("risk_score") >= F.col("threshold")
    total = lambda on, c, name: F.sum(F.when(on, F.col(c)).otherwise(0)).alias(name)
    return with_rates(x.groupBy(*keys, "threshold").agg(total(over, "pos", "tp"), total(over, "neg", "fp"), total(~over, "neg", "tn"), total(~over, "pos", "fn")))


def best_threshold(curve: DataFrame, *keys: str) -> DataFrame:
    """Highest F1, the lowest threshold on ties."""
    return curve.groupBy(*keys).agg(F.max_by(F.struct("threshold", "f1", "precision", "recall"), F.struct("f1", -F.col("threshold"))).alias("b")).select(*keys, "b.*")


def auc_pr(curve: DataFrame, key: str = "symbol") -> DataFrame:
    """Trapezoids over points in order of recall."""
    w = Window.partitionBy(key).orderBy("recall", "threshold")
    r0, p0 = F.lag("recall").over(w), F.lag("precision").over(w)
    return curve.withColumn("_a", (F.col("recall") - r0) * (F.col("precision") + p0) / 2).groupBy(key).agg(F.coalesce(F.sum("_a"), F.lit(0.0)).alias("auc"))


def lead_time(scores: DataFrame, starts: DataFrame, score_at: int = 60, minutes: int = 60) -> DataFrame:
    """Mean and median minutes from the last alert before a cascade start, within the lookback."""
    alerts = scores.filter(F.col("risk_score") >= score_at).select("symbol", F.col("time").alias("_t")).withColumn("_v", F.col("_t"))
    s = starts.select("symbol", F.col("start_time"), (F.col("start_time") - F.expr("interval 1 second")).alias("_until"))
    j = asof_backward(s, alerts, "_v", left_ts="_until", right_ts="_t", name="alert")
    lead = (F.unix_millis("start_time") - F.unix_millis("alert")) / 60_000.0
    near = F.unix_micros("start_time") - F.unix_micros("alert") <= minutes * 60_000_000
    return j.withColumn("lead", F.when(near, lead)).groupBy("symbol").agg(F.count("lead").alias("alerted"), F.avg("lead").alias("mean"), F.median("lead").alias("median"))


def calibration_bins(labelled: DataFrame, *keys: str, width: int = 1) -> DataFrame:
    """Per score bin: centre, total, positive. Width 1 gives the 101 integer scores."""
    bin_ = F.floor(F.col("risk_score") / width) * width
    out = labelled.groupBy(*keys, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("total"), F.count_if("actual").alias("positive"))
    return out.withColumn("centre", F.col("bin") + (F.lit(0.0) if width == 1 else F.lit(width / 2)))


FIT = "intercept double, slope double, var_a double, cov_ab double, var_b double, log_lik double, iterations long, converged boolean"


def fit_calibration(bins: DataFrame, key: str, ridge: float = 0.001, steps: int = 25, start: tuple[float, float] | None = None) -> DataFrame:
    """Ridge logistic fit of every model's bins at once (model x symbol x fold), by Newton steps; covariance is the inverse Hessian.

    A model without positives gets intercept -5 and slope 0.1. A bin frame has at most 101 rows a model.
    """

    def kernel(pdf):
        import numpy as np
        import pandas as pd

        s, n, y = (pdf[c].to_numpy(float) for c in ("centre", "total", "positive"))
        row = {key: pdf[key].iloc[0]}
        if y.sum() <= 0:
            return pd.DataFrame([{**row, "intercept": -5.0, "slope": 0.1, "var_a": None, "cov_ab": None, "var_b": None, "log_lik": 0.0, "iterations": 0, "converged": False}])
        base = min(y.sum() / n.sum(), 1 - 1e-9)
        w = np.array(start if start else (np.log(base / (1 - base)), 0.0))
        x, done, used = np.stack((np.ones_like(s), s), 1), False, 0
        hessian = np.eye(2)
        for used in range(1, steps + 1):  # noqa: B007
            p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
            hessian = (x.T * (n * p * (1 - p))) @ x + ridge * np.eye(2)
            move = np.linalg.solve(hessian, x.T @ (y - n * p) - ridge * w)
            w = w + move
            if np.abs(move).max() < 1e-8:
                done = True
                break
        p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -500, 500))), 1e-15, 1 - 1e-15)
        cov = np.linalg.inv(hessian)
        lik = float((y * np.log(p) + (n - y) * np.log(1 - p)).sum())
        return pd.DataFrame([{**row, "intercept": w[0], "slope": w[1], "var_a": cov[0, 0], "cov_ab": cov[0, 1], "var_b": cov[1, 1], "log_lik": lik, "iterations": used, "converged": done}])

    return bins.groupBy(key).applyInPandas(kernel, f"{key} {dict(bins.dtypes)[key]}, {FIT}")


def apply_calibration(scores: DataFrame, params: DataFrame, key: str, z_alpha: float = 1.96) -> DataFrame:
    """Adds p_hat, and its Wald interval (lower, upper) where ``params`` has a covariance; without one the interval is the point."""
    covariance = [F.col(c) if c in params.columns else F.lit(None).cast("double").alias(c) for c in ("var_a", "cov_ab", "var_b")]
    p = params.select(key, F.struct("intercept", "slope", *covariance).alias("_p"))
    c = calibrated_interval(F.col("risk_score"), *[F.col(f"_p.{n}") for n in ("intercept", "slope", "var_a", "cov_ab", "var_b")], z_alpha)
    return scores.join(p, key).withColumn("_c", c).withColumns({"p_hat": F.col("_c.probability"), "lower": F.col("_c.lower"), "upper": F.col("_c.upper")}).drop("_p", "_c")


def feature_summary(features: DataFrame) -> DataFrame:
    """Rows, warm rows, mean and deviation of the features and the score's percentiles, per symbol."""
    both = lambda c: (F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"))
    q = F.percentile("risk_score", F.array(*map(F.lit, (0.5, 0.95, 0.99)))).alias("_q")
    out = features.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.count_if("warm").alias("n_warm"), *[x for c in ("ret_z", "rv", "oi_z", "risk_score") for x in both(c)], q)
    return out.select("*", *[F.col("_q")[i].alias(n) for i, n in enumerate(("p50", "p95", "p99"))]).drop("_q")


#: Texts of the verdict.
VERDICTS = {
    "meaningful": "Model shows meaningful discriminative ability (F1=%s, BSS=%s). ",
    "weak": "Model shows weak but non-trivial signal (F1=%s, BSS=%s). ",
    "none": "Model shows no discriminative ability on this data. ",
    "actionable": "Average lead time of %s minutes provides actionable warning. ",
    "short": "Lead time of %s minutes is short but non-zero. ",
    "evaluated": "Track B evaluated with %d liquidation events.",
    "blocked": "Track B (liquidation cascades) blocked on data: live ingestion required.",
}


def fixed(c: Column, digits: int) -> Column:
    """A double with so many decimals, as C prints it: the binary value is rounded (half to even), not its shortest decimal."""
    word = F.when(F.isnan(c), "nan").when(c == float("inf"), "inf").when(c == float("-inf"), "-inf")
    return F.coalesce(word, F.call_function("format_number", c, F.lit("0." + "0" * digits)))


def verdict(results: DataFrame) -> DataFrame:
    """Adds grade and text from best_f1, skill, lead_minutes and liquidations."""
    c = F.col
    rates = (fixed(c("best_f1"), 3), fixed(c("skill"), 3))
    grade = F.when((c("best_f1") >= 0.15) & (c("skill") > 0), "meaningful").when(c("best_f1") > 0, "weak").otherwise("none")
    lead = F.coalesce(c("lead_minutes"), F.lit(0.0))
    text = F.concat(
        F.when(c("grade") == "meaningful", F.format_string(VERDICTS["meaningful"], *rates)).when(c("grade") == "weak", F.format_string(VERDICTS["weak"], *rates)).otherwise(VERDICTS["none"]),
        F.when(lead > 5, F.format_string(VERDICTS["actionable"], fixed(lead, 1))).when(lead > 0, F.format_string(VERDICTS["short"], fixed(lead, 1))).otherwise(""),
        F.when(c("liquidations") > 0, F.format_string(VERDICTS["evaluated"], "liquidations")).otherwise(VERDICTS["blocked"]),
    )
    return results.withColumn("grade", grade).withColumn("text", text)


def brier_rowwise(scored: DataFrame, *keys: str, p: str = "p_hat") -> DataFrame:
    y = F.col("actual").cast("double")
    out = scored.groupBy(*keys).agg(F.avg((F.col(p) - y) * (F.col(p) - y)).alias("brier"), F.avg(y).alias("rate"))
    clim = F.col("rate") * (1 - F.col("rate"))
    return out.select(*keys, "brier", clim.alias("climatology"), F.when(clim > 0, 1 - F.col("brier") / F.when(clim > 0, clim)).otherwise(0.0).alias("skill"))


def brier_binned(bins: DataFrame, p: Column, *keys: str) -> DataFrame:
    """Against bin rates: weighted squared error, that of the base rate, and the skill."""
    rate = F.col("positive") / F.col("total")
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    base = F.sum("positive").over(w) / F.sum("total").over(w)
    x = bins.withColumn("_e", F.col("total") * (p - rate) * (p - rate)).withColumn("_b", F.col("total") * (base - rate) * (base - rate))
    out = x.groupBy(*keys).agg((F.sum("_e") / F.sum("total")).alias("brier"), (F.sum("_b") / F.sum("total")).alias("baseline"))
    return out.withColumn("skill", F.when(F.col("baseline") > 0, 1 - F.col("brier") / F.when(F.col("baseline") > 0, F.col("baseline"))).otherwise(0.0))


def reliability_curve(scored: DataFrame, *keys: str, width: int = 10, p: str = "p_hat") -> DataFrame:
    band = (F.floor(F.least(F.col("risk_score"), F.lit(99)) / width) * width).alias("band")
    return scored.groupBy(*keys, band).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("predicted"), F.avg(F.col("actual").cast("double")).alias("observed"))


def walk_forward(labelled: DataFrame, cut: Column, ts: str = "time") -> DataFrame:
    """Fit per symbol on rows before ``cut``, row-wise Brier score and skill on the rest."""
    params = fit_calibration(calibration_bins(labelled.filter(F.col(ts) < cut), "symbol"), "symbol")
    return brier_rowwise(apply_calibration(labelled.filter(F.col(ts) >= cut), params, "symbol"), "symbol")


def score_histogram(scores: DataFrame, *keys: str) -> DataFrame:
    bucket = F.least(F.lit(10), F.floor(F.col("risk_score") / 10)).cast("int").alias("bucket")
    h = scores.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("n"))
    return h.withColumn("pct", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)) * 100.0)
