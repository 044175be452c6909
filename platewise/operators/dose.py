"""Dose response: rank correlation, curve fits, benchmark doses, directions, phases and trajectories."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.functions import special as S
from platewise.operators.stats import MAD_SCALE, average_rank, benjamini_hochberg, correlation, join_fit, to_long


def usable(df: DataFrame, compound: str, dose: str, min_doses: int = 2) -> DataFrame:
    """Rows of finite positive dose, of compounds with enough distinct ones."""
    rows = df.where(f"`{dose}` > 0 and `{dose}` < double('Infinity')")
    n = rows.groupBy(compound).agg(F.count_distinct(dose).alias("__n")).where(F.col("__n") >= min_doses).select(compound)
    return rows.join(n, compound, "left_semi")


def spearman(df: DataFrame, compound: str, dose: str, response: str, p_values: bool = True) -> DataFrame:
    """(compound, n, rho[, pvalue]): correlation of average ranks."""
    rows = usable(df, compound, dose).where(f"`{response}` is not null")
    ranked = rows.select(compound, average_rank(dose, [compound]).alias("a"), average_rank(response, [compound]).alias("b"))
    out = ranked.groupBy(compound).agg(F.count(F.lit(1)).alias("n"), correlation("a", "b").alias("rho"))
    if not p_values:
        return out
    t = F.col("rho") * F.sqrt((F.col("n") - 2) / F.when(F.abs("rho") < 1, 1 - F.col("rho") * F.col("rho")))
    return out.withColumn("pvalue", F.when(F.abs("rho") >= 1, 0.0).otherwise(S.col_t_sf2(t, F.when(F.col("n") > 2, F.col("n") - 2))))


def four_parameter(x: np.ndarray, bottom: float, top: float, log_ec50: float, slope: float) -> np.ndarray:
    return bottom + (top - bottom) / (1.0 + 10.0 ** np.clip((log_ec50 - x) * slope, -60, 60))


def fit_curve(log_dose: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """(bottom, top, log ec50, slope), r squared: a grid over ec50 and slope with linear ends, then Gauss-Newton steps."""
    total = ((y - y.mean()) ** 2).sum()
    lo, hi = log_dose.min(), log_dose.max()
    best, par = np.inf, np.array([y.min(), y.max(), log_dose.mean(), 1.0])
    for e in np.linspace(lo - 0.5, hi + 0.5, 25):
        for h in (0.3, 0.6, 1.0, 1.7, 3.0, -0.6, -1.0, -1.7):
            g = 1.0 / (1.0 + 10.0 ** np.clip((e - log_dose) * h, -60, 60))
            a = np.column_stack([1.0 - g, g])
            ends, *_ = np.linalg.lstsq(a, y, rcond=None)
            sse = ((y - a @ ends) ** 2).sum()
            if sse < best:
                best, par = sse, np.array([*ends, e, h])
    damp = 1e-3
    for _ in range(200):
        f = four_parameter(log_dose, *par)
        jac = np.column_stack([(four_parameter(log_dose, *(par + d)) - f) / 1e-6 for d in np.eye(4) * 1e-6])
        r = y - f
        h = jac.T @ jac
        step = np.linalg.lstsq(h + damp * np.diag(np.maximum(np.diag(h), 1e-12)), jac.T @ r, rcond=None)[0]
        trial = ((y - four_parameter(log_dose, *(par + step))) ** 2).sum()
        if trial < best:
            done = best - trial < 1e-12 * max(best, 1e-300)
            best, par, damp = trial, par + step, damp / 3.0
            if done:
                break
        else:
            damp *= 4.0
            if damp > 1e8:
                break
    return par, 1.0 - best / total if total > 0 else 0.0


def dose_response(df: DataFrame, compound: str, dose: str, response: str, min_doses: int = 4, min_r_squared: float = 0.8) -> DataFrame:
    """(compound, n_doses, rho, ec50, slope, top, bottom, r_squared, active): four-parameter logistic of each compound."""
    rows = usable(df, compound, dose).where(f"`{response}` is not null").select(F.col(compound).cast("string").alias("compound"), F.col(dose).cast("double").alias("dose"), F.col(response).cast("double").alias("y"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = np.log10(pdf["dose"].to_numpy(float)), pdf["y"].to_numpy(float)
        n = len(np.unique(x))
        rx, ry = S.average_ranks(x), S.average_ranks(y)
        rho = float(np.corrcoef(rx, ry)[0, 1]) if rx.std() > 0 and ry.std() > 0 else np.nan
        out = {"compound": pdf["compound"].iloc[0], "n_doses": n, "rho": rho, "ec50": np.nan, "slope": np.nan, "top": np.nan, "bottom": np.nan, "r_squared": np.nan, "active": False}
        if n >= min_doses and y.std() > 0:
            par, r2 = fit_curve(x, y)
            out |= {"ec50": float(10.0 ** np.clip(par[2], -300, 300)), "slope": par[3], "top": par[1], "bottom": par[0], "r_squared": r2, "active": bool(r2 >= min_r_squared)}
        return pd.DataFrame([out])

    return rows.groupBy("compound").applyInPandas(run, "compound string, n_doses long, rho double, ec50 double, slope double, top double, bottom double, r_squared double, active boolean")


def hit_call(df: DataFrame, compound: str, dose: str, response: str, cutoff: float) -> DataFrame:
    """(compound, hitcall): product of the chances that the curve beats a constant, its top passes the cutoff and a
    response at some dose does; errors are Student t with 4 degrees of freedom."""
    rows = usable(df, compound, dose).where(f"`{response}` is not null").select(F.col(compound).cast("string").alias("compound"), F.col(dose).cast("double").alias("dose"), F.col(response).cast("double").alias("y"))

    def loglik(r: np.ndarray) -> float:
        best = -np.inf
        for s in np.geomspace(max(1e-9, np.abs(r).mean() / 10 + 1e-12), max(1e-6, np.abs(r).max() * 3), 40):
            z = r / s
            v = float((np.log(0.375) - 2.5 * np.log1p(z * z / 4.0) - np.log(s)).sum())
            best = max(best, v)
        return best

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = np.log10(pdf["dose"].to_numpy(float)), pdf["y"].to_numpy(float)
        med = pdf.groupby("dose")["y"].median()
        if len(med) < 3 or y.std() == 0:
            return pd.DataFrame({"compound": [pdf["compound"].iloc[0]], "hitcall": [0.0]})
        par, _ = fit_curve(x, y)
        fit, line = four_parameter(x, *par), np.polyval(np.polyfit(x, y, 1), x)
        aic = {"constant": 2 * 1 - 2 * loglik(y), "curve": 2 * 5 - 2 * loglik(y - fit), "line": 2 * 3 - 2 * loglik(y - line)}
        win = min(("curve", "line"), key=aic.get)
        p1 = 1.0 / (1.0 + np.exp(np.clip((aic[win] - aic["constant"]) / 2.0, -60, 60)))
        best = fit if win == "curve" else line
        sd = max(1e-9, (y - best).std())
        top = best[np.abs(best).argmax()]
        p2 = 1.0 - float(np.prod(S.norm_cdf((cutoff - np.abs(med.to_numpy())) / sd)))
        p3 = float(S.norm_cdf(np.array([(abs(top) - cutoff) / sd]))[0])
        return pd.DataFrame({"compound": [pdf["compound"].iloc[0]], "hitcall": [float(p1 * p2 * p3)]})

    return rows.groupBy("compound").applyInPandas(run, "compound string, hitcall double")


def control_scale(df: DataFrame, features: Sequence[str], control: Column) -> DataFrame:
    """(feature, m, s): control median and 1.4826 MAD of features with a spread."""
    long = to_long(df.where(control), [], features)
    med = long.groupBy("feature").agg(F.median("value").alias("m"))
    far = join_fit(long, med, ["feature"]).groupBy("feature").agg((F.median(F.abs(F.col("value") - F.col("m"))) * MAD_SCALE).alias("s"), F.first("m").alias("m"))
    return far.where("s > 1e-18")


def dose_features(df: DataFrame, features: Sequence[str], compound: str, dose: str, control: Column, cutoff_mads: float = 3.0, min_doses: int = 4, p_values: bool = True) -> DataFrame:
    """(compound, feature, bmd, max_z, direction, rho[, pvalue, qvalue]): first dose at which |median z| reaches the
    cutoff, by interpolation on the logarithm of the dose; q within the compound."""
    rows = usable(df.where(~control), compound, dose, min_doses)
    z = join_fit(to_long(rows, [compound, dose], features), control_scale(df, features, control), ["feature"], "inner")
    z = z.withColumn("z", (F.col("value") - F.col("m")) / F.col("s"))
    med = z.groupBy(F.col(compound).alias("compound"), "feature", F.log10(dose).alias("x")).agg(F.median("z").alias("z"))
    w = Window.partitionBy("compound", "feature").orderBy("x")
    a, b = F.abs(F.lag("z").over(w)), F.abs("z")
    cross = F.when((b >= cutoff_mads) & a.isNull(), F.col("x")).when((b >= cutoff_mads) & (a < cutoff_mads), F.lag("x").over(w) + (cutoff_mads - a) / (b - a) * (F.col("x") - F.lag("x").over(w)))
    ranked = med.withColumns({"cross": cross, "rx": average_rank("x", ["compound", "feature"]), "rz": average_rank("z", ["compound", "feature"])})
    out = ranked.groupBy("compound", "feature").agg(
        F.pow(F.lit(10.0), F.min("cross")).alias("bmd"), F.max(F.abs("z")).alias("max_z"), F.max_by("z", F.struct(F.abs("z"), "x")).alias("peak"), correlation("rx", "rz").alias("rho"), F.count(F.lit(1)).alias("n_doses")
    )
    out = out.withColumn("direction", F.signum("peak").cast("int")).drop("peak")
    if not p_values:
        return out
    t = F.col("rho") * F.sqrt((F.col("n_doses") - 2) / F.when(F.abs("rho") < 1, 1 - F.col("rho") * F.col("rho")))
    return benjamini_hochberg(out.withColumn("pvalue", F.when(F.abs("rho") >= 1, 0.0).otherwise(S.col_t_sf2(t, F.when(F.col("n_doses") > 2, F.col("n_doses") - 2)))), by=["compound"], tie=["feature"])


def _norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(v, lambda x: x * x), F.lit(0.0), lambda s, x: s + x))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def dose_direction(df: DataFrame, features: Sequence[str], compound: str, dose: str, control: Column, half: Column | None = None) -> DataFrame:
    """(compound, dose, amplitude, step, cosine_to_top[, split_cosine]): the median z profile along the doses.

    amplitude: root mean square; step: of the difference from the dose below (the first: its amplitude);
    cosine_to_top: with the highest dose; split_cosine: between the median profiles of two halves of the rows.
    """
    rows = usable(df.where(~control), compound, dose)
    ids = [compound, dose, "__h"]
    scale = control_scale(df, features, control)
    z = join_fit(to_long(rows.withColumn("__h", half if half is not None else F.lit(True)), ids, features), scale, ["feature"], "inner")
    z = z.withColumn("z", (F.col("value") - F.col("m")) / F.col("s"))

    def packed(part: DataFrame, name: str) -> DataFrame:
        med = part.groupBy(F.col(compound).alias("compound"), F.col(dose).cast("double").alias("dose"), "feature").agg(F.median("z").alias("z"))
        v = F.transform(F.array_sort(F.collect_list(F.struct("feature", "z"))), lambda x: x["z"])
        return med.groupBy("compound", "dose").agg(v.alias(name))

    v = packed(z, "v")
    w = Window.partitionBy("compound").orderBy("dose")
    top = F.last("v").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    low = F.lag("v").over(w)
    k = F.sqrt(F.size("v").cast("double"))
    step = F.when(low.isNull(), _norm(F.col("v"))).otherwise(_norm(F.zip_with(F.col("v"), low, lambda a, b: a - b))) / k
    rows = v.withColumns({"top": top, "step": step})
    cos = _dot(F.col("v"), F.col("top")) / F.when(_norm(F.col("v")) * _norm(F.col("top")) > 0, _norm(F.col("v")) * _norm(F.col("top")))
    out = rows.select("compound", "dose", (_norm(F.col("v")) / k).alias("amplitude"), "step", cos.alias("cosine_to_top"))
    if half is None:
        return out
    ab = packed(z.where("__h"), "a").join(packed(z.where("not __h"), "b"), ["compound", "dose"])
    low2 = _norm(F.col("a")) * _norm(F.col("b"))
    split = ab.select("compound", "dose", F.when(F.size("a") == F.size("b"), _dot(F.col("a"), F.col("b")) / F.when(low2 > 0, low2)).alias("split_cosine"))
    return out.join(split, ["compound", "dose"], "left")


def label_phases(direction: DataFrame, amplitude_null: float, reproducible: float = 0.5, toxic: Column | None = None) -> DataFrame:
    """phase of each dose, walking down from the highest dose that is not cytotoxic.

    active: above the null amplitude and reproducible; of the doses reached without an inactive one in between, those
    that still move (step > sqrt 2 null) are responding, others saturated; the rest is inactive.
    """
    rows = direction.withColumn("__tox", toxic if toxic is not None else F.lit(False))
    active = (F.col("amplitude") > amplitude_null) & (F.coalesce("split_cosine", F.lit(1.0)) >= reproducible)
    rows = rows.withColumn("__act", active)
    w = Window.partitionBy("compound").orderBy(F.desc("dose")).rowsBetween(Window.unboundedPreceding, 0)
    broken = F.max(F.when(~F.col("__tox") & ~F.col("__act"), 1).otherwise(0)).over(w)
    phase = F.when(F.col("__tox"), "cytotoxic").when(broken == 1, "inactive").when(F.col("step") > amplitude_null * 2.0**0.5, "responding").otherwise("saturated")
    return rows.withColumn("phase", phase).drop("__tox", "__act")


def null_amplitude(df: DataFrame, features: Sequence[str], control: Column, row_id: str, n_rows: int, n_draws: int = 200, seed: int = 0) -> float:
    """Median amplitude of the median profiles of n_rows random controls."""
    z = join_fit(to_long(df.where(control), [row_id], features), control_scale(df, features, control), ["feature"], "inner").withColumn("z", (F.col("value") - F.col("m")) / F.col("s"))
    draws = df.where(control).select(row_id).crossJoin(df.sparkSession.range(n_draws).withColumnRenamed("id", "d"))
    taken = draws.withColumn("k", F.row_number().over(Window.partitionBy("d").orderBy(F.xxhash64(F.lit(seed), "d", row_id)))).where(F.col("k") <= n_rows)
    med = taken.join(z, row_id).groupBy("d", "feature").agg(F.median("z").alias("z"))
    out = med.groupBy("d").agg(F.sqrt(F.avg(F.col("z") * F.col("z"))).alias("a")).agg(F.median("a")).first()[0]
    return float(out or 0.0)


def dose_trajectory(df: DataFrame, features: Sequence[str], compound: str, dose: str, n_positions: int = 3) -> DataFrame:
    """(compound, n_doses, window_low, window_high, feature, position, value): medians along log dose rescaled to [0, 1],
    interpolated at even positions; compounds of one dose are left out."""
    rows = usable(df, compound, dose)
    med = to_long(rows, [compound, dose], features).groupBy(F.col(compound).alias("compound"), "feature", F.log10(F.col(dose).cast("double")).alias("x")).agg(F.median("value").alias("y"))
    part = Window.partitionBy("compound", "feature")
    span = med.withColumns({"lo": F.min("x").over(part), "hi": F.max("x").over(part), "n_doses": F.count(F.lit(1)).over(part)}).where("hi > lo")
    pos = span.withColumn("u", (F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    w = part.orderBy("u")
    seg = pos.withColumns({"u2": F.lead("u").over(w), "y2": F.lead("y").over(w)}).where("u2 is not null")
    at = F.explode(F.array(*[F.lit(i / (n_positions - 1)) for i in range(n_positions)])).alias("position")
    seg = seg.select("*", at).where("position >= u and (position < u2 or (position = 1.0 and u2 = 1.0))")
    value = F.col("y") + (F.col("position") - F.col("u")) / (F.col("u2") - F.col("u")) * (F.col("y2") - F.col("y"))
    return seg.select("compound", "feature", "n_doses", F.pow(F.lit(10.0), "lo").alias("window_low"), F.pow(F.lit(10.0), "hi").alias("window_high"), "position", value.alias("value"))
