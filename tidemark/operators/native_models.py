"""Forecast models in the JVM: closed forms over windows, and recursions as folds over each series' ordered array.

Each returns (unique_id, step, ds, yhat, sigma); metrics.with_bounds turns sigma into intervals. `ahead` runs any set of them from the ends
of the series or from the cutoffs of a walk-forward run: a window's row holds the state of a model fitted on the rows up to it, so no
history is copied for a cutoff."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, series_models as S
from ..functions.contract import ID, TARGET, TIME, by_time, check_horizon, positions, whole

FLOOR = 1e-12


def residual_sigma(df: DataFrame, fitted: Column) -> DataFrame:
    """(unique_id, s): root of sum r^2 / (n - 1), uncentred and safe from overflow, with fallbacks to differences and to 1."""
    rows = df.select(ID, (F.col(TARGET) - fitted).alias("r"), (F.col(TARGET) - F.lag(TARGET).over(by_time())).alias("d"), F.col(TARGET).alias("v"))
    rows = rows.withColumns({f"{c}_top": F.max(F.abs(c)).over(whole()) for c in "rd"})

    def spread(c):
        n, top = F.nullif(F.count(c) - 1, F.lit(0)), F.col(f"{c}_top")
        plain = F.sqrt(F.sum(F.col(c) * F.col(c)) / n)
        scaled = F.max(top) * F.sqrt(F.sum(F.pow(F.col(c) / F.nullif(top, F.lit(0.0)), F.lit(2.0))) / n)
        return F.when(plain < float("inf"), plain).otherwise(scaled)

    sigma = F.when(F.count("r") >= 2, spread("r")).when((F.count("v") >= 3) & (F.count("d") >= 2), spread("d")).otherwise(1.0)
    return rows.groupBy(ID).agg(F.greatest(sigma, F.lit(FLOOR)).alias("s"))


# ---- closed forms over windows -----------------------------------------------------------------------------------


def _fitted(m: S.Model) -> Column:
    """In-sample one-step forecast of a row, from the rows before it."""
    w = by_time()
    before = F.lag(TARGET).over(w)
    if type(m) is S.Naive:
        return before
    if type(m) is S.SeasonalNaive:
        return F.lag(TARGET, m.season_length).over(w)
    if type(m) is S.WindowAverage:
        return F.avg(TARGET).over(w.rowsBetween(-m.window, -1))
    pos = F.row_number().over(w) - 1
    return F.when(pos >= 2, before + (before - F.first(TARGET).over(w)) / F.nullif(pos - 1, F.lit(0)))  # drift


def _state(m: S.Model) -> Column:
    """What a model fitted on the rows up to this one needs besides sigma."""
    w = by_time()
    if type(m) is S.SeasonalNaive:
        return F.collect_list(TARGET).over(w.rowsBetween(-(m.season_length - 1), 0))
    if type(m) is S.WindowAverage:
        return F.array(F.avg(TARGET).over(w.rowsBetween(-(m.window - 1), 0)))
    return F.array(F.col(TARGET), F.first(TARGET).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def _ahead_of(m: S.Model, state: Column, s: Column, n: Column, k: Column) -> tuple[Column, Column]:
    """(yhat, sigma) of step k."""
    if type(m) is S.SeasonalNaive:
        return F.get(state, (k - 1) % F.size(state)), s * F.sqrt(F.floor((k - 1) / m.season_length) + 1)
    if type(m) is S.WindowAverage:
        return state[0], s
    if type(m) is S.Naive:
        return state[0], s * F.sqrt(k)
    n1 = F.nullif(n - 1, F.lit(0))
    slope = F.coalesce((state[0] - state[1]) / n1, F.lit(0.0))
    return state[0] + k * slope, s * F.sqrt(k * (1 + F.coalesce(k / n1, F.lit(0.0))))


def _closed(df: DataFrame, models: list, h: int, cuts) -> DataFrame:
    rows = positions(df).withColumn("d", F.col(TARGET) - F.lag(TARGET).over(by_time()))
    rows = rows.withColumns({f"r{i}": F.col(TARGET) - _fitted(m) for i, (_, m) in enumerate(models)})
    rows = rows.withColumns({f"top_{c}": F.max(F.abs(c)).over(whole()) for c in ("d", *[f"r{i}" for i in range(len(models))])})
    upto = by_time().rowsBetween(Window.unboundedPreceding, 0)

    def spread(c):
        n, top = F.nullif(F.count(c).over(upto) - 1, F.lit(0)), F.col(f"top_{c}")
        plain = F.sqrt(F.sum(F.col(c) * F.col(c)).over(upto) / n)
        scaled = top * F.sqrt(F.sum(F.pow(F.col(c) / F.nullif(top, F.lit(0.0)), F.lit(2.0))).over(upto) / n)
        return F.when(plain < float("inf"), plain).otherwise(scaled)

    def sigma(c):
        by_rows = F.when(F.count(c).over(upto) >= 2, spread(c)).when((F.col("pos") >= 2) & (F.count("d").over(upto) >= 2), spread("d"))
        return F.greatest(F.coalesce(by_rows, F.lit(1.0)), F.lit(FLOOR))

    rows = rows.withColumns({f"s{i}": sigma(f"r{i}") for i in range(len(models))} | {f"state{i}": _state(m) for i, (_, m) in enumerate(models)})
    size, k = F.col("pos") + 1, F.col("step")
    at = rows.withColumn("cut", size).filter(cuts(F.col("cut"), F.col("n")))
    at = at.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(h))))
    each = []
    for i, (name, m) in enumerate(models):
        yhat, s = _ahead_of(m, F.col(f"state{i}"), F.col(f"s{i}"), F.col("cut"), k)
        each.append(F.struct(F.lit(name).alias("model"), yhat.cast("double").alias("yhat"), s.cast("double").alias("sigma"), F.lit(None).cast("string").alias("error")))
    return at.select(ID, F.col("cut").cast("int").alias("cut"), F.col("n").cast("int").alias("n"), "step", F.explode(F.array(*each)).alias("f")).select(ID, "cut", "n", "step", "f.*")


# ---- recursions as folds -----------------------------------------------------------------------------------------


def _ordered(df: DataFrame) -> DataFrame:
    rows = df.groupBy(ID).agg(F.array_sort(F.collect_list(F.struct(TIME, TARGET))).alias("rows"))
    return rows.select(ID, F.transform("rows", lambda r: r[TARGET]).alias("ys"))


def _rest(ys: Column) -> Column:
    return F.slice(ys, 2, F.greatest(F.size(ys) - 1, F.lit(0)))


def _sigma_of(sse: Column, n: Column, ys: Column) -> Column:
    """Root of sse / (n - 1); of the differences where there are fewer than two residuals; else 1."""
    start = F.struct(F.lit(None).cast("double").alias("y"), F.lit(0.0).alias("sse"))
    square = lambda a, y: F.struct(y.alias("y"), (a["sse"] + F.coalesce(F.pow(y - a["y"], F.lit(2.0)), F.lit(0.0))).alias("sse"))
    by_steps = F.sqrt(F.aggregate(ys, start, square)["sse"] / F.nullif(F.size(ys) - 2, F.lit(0)))
    root = F.when(n >= 2, F.sqrt(sse / F.nullif(n - 1, F.lit(0)))).when(F.size(ys) >= 3, by_steps)
    return F.greatest(F.coalesce(root, F.lit(1.0)), F.lit(FLOOR))


def _fold(m: S.Model, ys: Column) -> Column:
    """The state of a model fitted on ys: a struct that has s."""
    if type(m) is S.SES:
        alpha = float(m.alpha)
        start = F.struct(F.get(ys, 0).alias("level"), F.lit(0.0).alias("sse"))
        step = lambda a, y: F.struct((alpha * y + (1 - alpha) * a["level"]).alias("level"), (a["sse"] + (y - a["level"]) * (y - a["level"])).alias("sse"))
        a = F.aggregate(_rest(ys), start, step)
        return F.struct(a["level"].alias("level"), F.lit(0.0).alias("trend"), _sigma_of(a["sse"], F.size(ys) - 1, ys).alias("s"))
    if type(m) is S.Holt:
        alpha, beta = float(m.alpha), float(m.beta)
        start = F.struct(F.get(ys, 0).alias("level"), (F.get(ys, 1) - F.get(ys, 0)).alias("trend"), F.lit(0.0).alias("sse"))

        def step(a, y):
            ahead = a["level"] + a["trend"]
            level = alpha * y + (1 - alpha) * ahead
            trend = beta * (level - a["level"]) + (1 - beta) * a["trend"]
            return F.struct(level.alias("level"), trend.alias("trend"), (a["sse"] + (y - ahead) * (y - ahead)).alias("sse"))

        a = F.aggregate(_rest(ys), start, step)
        return F.struct(a["level"].alias("level"), a["trend"].alias("trend"), _sigma_of(a["sse"], F.size(ys) - 1, ys).alias("s"))
    alpha = float(m.alpha)
    if type(m) is S.TSB:
        beta, hits = float(m.beta), F.filter(ys, lambda y: y > 0)
        mean = F.coalesce(F.aggregate(hits, F.lit(0.0), lambda a, y: a + y) / F.nullif(F.size(hits), F.lit(0)), F.lit(0.0))
        start = F.struct((F.size(hits) / F.size(ys)).alias("p"), mean.alias("size"), F.lit(0.0).alias("sse"))

        def step(a, y):
            hit, guess = y > 0, a["p"] * a["size"]
            p = beta * hit.cast("double") + (1 - beta) * a["p"]
            size = F.when(hit, alpha * y + (1 - alpha) * a["size"]).otherwise(a["size"])
            return F.struct(p.alias("p"), size.alias("size"), (a["sse"] + (y - guess) * (y - guess)).alias("sse"))

        a = F.aggregate(ys, start, step)
        return F.struct((a["p"] * a["size"]).alias("level"), F.lit(0.0).alias("trend"), _sigma_of(a["sse"], F.size(ys), ys).alias("s"))
    none = F.lit(None).cast("double")
    start = F.struct(none.alias("size"), none.alias("gap"), F.lit(1.0).alias("since"), F.lit(0.0).alias("sse"), F.lit(0).alias("n"))

    def step(a, y):
        seen, hit = a["size"].isNotNull(), y > 0
        rate = a["size"] / a["gap"]
        size = F.when(hit & seen, alpha * y + (1 - alpha) * a["size"]).when(hit, y).otherwise(a["size"])
        gap = F.when(hit & seen, alpha * a["since"] + (1 - alpha) * a["gap"]).when(hit, a["since"]).otherwise(a["gap"])
        sse = a["sse"] + F.when(seen, (y - rate) * (y - rate)).otherwise(0.0)
        since = F.when(hit, 1.0).otherwise(a["since"] + 1)
        return F.struct(size.alias("size"), gap.alias("gap"), since.alias("since"), sse.alias("sse"), (a["n"] + seen.cast("int")).alias("n"))

    a = F.aggregate(ys, start, step)
    rate = F.coalesce(a["size"] / a["gap"], F.lit(0.0))
    return F.struct(rate.alias("level"), F.lit(0.0).alias("trend"), _sigma_of(a["sse"], a["n"], ys).alias("s"))


def _grown(m: S.Model, s: Column, k: Column) -> Column:
    if type(m) is S.SES:
        return s * F.sqrt(1 + (k - 1) * float(m.alpha) ** 2)
    if type(m) is S.Holt:  # 1 + sum over j < k of (alpha (1 + j beta))^2
        alpha, beta = float(m.alpha), float(m.beta)
        return s * F.sqrt(1 + alpha * alpha * ((k - 1) + beta * (k - 1) * k + beta * beta * (k - 1) * k * (2 * k - 1) / 6))
    return s


def _refusal(m: S.Model, ys: Column) -> Column:
    """Why a model refuses ys, or null."""
    if type(m) is S.Holt:
        return F.when(F.size(ys) < 2, F.concat(F.lit("ValueError: Holt needs 2 rows; a series has "), F.size(ys).cast("string")))
    if type(m) in (S.Croston, S.TSB):
        return F.when(F.exists(ys, lambda y: y < 0), F.lit("ValueError: demand must not be negative"))
    return F.lit(None).cast("string")


def _folded(df: DataFrame, models: list, h: int, cut_sizes) -> DataFrame:
    rows = _ordered(df).withColumn("n", F.size("ys"))
    rows = rows.withColumn("cut", F.explode(cut_sizes(F.col("n")))).withColumn("ys", F.slice("ys", F.lit(1), F.col("cut")))
    ys, k = F.col("ys"), F.col("step")
    rows = rows.select(ID, "n", "cut", *[F.struct(_fold(m, ys).alias("a"), _refusal(m, ys).alias("error")).alias(f"m{i}") for i, (_, m) in enumerate(models)])
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(h))))
    each = []
    for i, (name, m) in enumerate(models):
        a, bad = F.col(f"m{i}.a"), F.col(f"m{i}.error")
        fine = lambda c, bad=bad: F.when(bad.isNull(), c.cast("double"))
        each.append(F.struct(F.lit(name).alias("model"), fine(a["level"] + k * a["trend"]).alias("yhat"), fine(_grown(m, a["s"], k)).alias("sigma"), bad.alias("error")))
    return rows.select(ID, "cut", "n", "step", F.explode(F.array(*each)).alias("f")).select(ID, "cut", "n", "step", "f.*")


# ---- any set of models -------------------------------------------------------------------------------------------

_CLOSED, _FOLDED = (S.Naive, S.SeasonalNaive, S.Drift, S.WindowAverage), (S.Croston, S.TSB)


def is_native(m: S.Model) -> bool:
    """Whether a model (not a subclass of one) needs no fit but these plans."""
    given = type(m) is S.SES and m.alpha is not None or type(m) is S.Holt and m.alpha is not None and m.beta is not None
    return type(m) in _CLOSED or type(m) in _FOLDED or given


def ahead(df: DataFrame, models: list, h: int, windows: tuple[int, int] | None = None) -> DataFrame:
    """(unique_id, cut, n, step, model, yhat, sigma, error) of native models: labels and models. cut is the number of rows that a forecast
    has seen: all n, or with windows (number, step size) those before each held-out stretch of h rows."""
    h = check_horizon(h)
    count, stride = windows or (1, 1)
    held = h if windows else 0
    behind = lambda cut, n: n - held - cut
    cuts = lambda cut, n: (behind(cut, n) >= 0) & (behind(cut, n) <= (count - 1) * stride) & (behind(cut, n) % stride == 0)
    sizes = lambda n: F.filter(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: n - held - i * stride), lambda c: c > 0)
    df = df.select(ID, TIME, TARGET)
    closed, folded = [x for x in models if type(x[1]) in _CLOSED], [x for x in models if type(x[1]) not in _CLOSED]
    parts = ([_closed(df, closed, h, cuts)] if closed else []) + ([_folded(df, folded, h, sizes)] if folded else [])
    return reduce(DataFrame.unionByName, parts)


def _one(df: DataFrame, h: int, m: S.Model) -> DataFrame:
    f = ahead(df, [("m", m)], h).filter("error is null")
    return dates.future(dates.with_step(df), check_horizon(h)).join(f, [ID, "step"]).select(ID, "step", TIME, "yhat", "sigma")


def naive(df: DataFrame, h: int) -> DataFrame:
    return _one(df, h, S.Naive())


def seasonal_naive(df: DataFrame, h: int, m: int = 7) -> DataFrame:
    return _one(df, h, S.SeasonalNaive(m))


def drift(df: DataFrame, h: int) -> DataFrame:
    return _one(df, h, S.Drift())


def window_average(df: DataFrame, h: int, window: int = 7) -> DataFrame:
    return _one(df, h, S.WindowAverage(window))


def ses(df: DataFrame, h: int, alpha: float) -> DataFrame:
    """Simple exponential smoothing at a given alpha."""
    return _one(df, h, S.SES(alpha))


def holt(df: DataFrame, h: int, alpha: float, beta: float) -> DataFrame:
    """Holt's linear trend at given alpha and beta."""
    return _one(df, h, S.Holt(alpha, beta))


def croston(df: DataFrame, h: int, alpha: float = 0.1) -> DataFrame:
    """Intermittent demand: smoothed sizes over smoothed intervals."""
    return _one(df, h, S.Croston(alpha))


def tsb(df: DataFrame, h: int, alpha: float = 0.1, beta: float = 0.1) -> DataFrame:
    """Teunter-Syntetos-Babai: demand probability every period, size at demand."""
    return _one(df, h, S.TSB(alpha, beta))


def fitted(df: DataFrame, model: str, m: int = 7) -> DataFrame:
    """(unique_id, ds, y, fitted) of naive, seasonal_naive or window_average."""
    w = by_time()
    of = {"naive": F.lag(TARGET).over(w), "seasonal_naive": F.lag(TARGET, m).over(w), "window_average": F.avg(TARGET).over(w.rowsBetween(-m, -1))}
    return df.select(ID, TIME, TARGET, of[model].alias("fitted"))


def garch_path(df: DataFrame, omega: float, alpha: float, beta: float) -> DataFrame:
    """(unique_id, sigma2): last conditional variance of a GARCH(1,1) at given parameters, started at the mean square."""
    ys = F.col("ys")
    base = F.aggregate(ys, F.lit(0.0), lambda a, y: a + y * y) / F.size(ys)
    return _ordered(df).select(ID, F.aggregate(F.slice(ys, 1, F.size(ys) - 1), base, lambda v, y: omega + alpha * y * y + beta * v).alias("sigma2"))


def sbg_survival(params: DataFrame, h: int) -> DataFrame:
    """Shifted-beta-geometric survival of t = 0 ... h for rows (unique_id, alpha, beta)."""
    a, b = F.col("alpha"), F.col("beta")
    start = F.struct(F.array(F.lit(1.0)).alias("s"), (a / (a + b)).alias("p"))

    def step(x, t):
        p = F.when(t == 1, x["p"]).otherwise(x["p"] * (b + t - 2) / (a + b + t - 1))
        return F.struct(F.concat(x["s"], F.array(F.element_at(x["s"], -1) - p)).alias("s"), p.alias("p"))

    path = F.aggregate(F.sequence(F.lit(1), F.lit(h)), start, step)["s"]
    return params.select(ID, F.posexplode(path).alias("t", "survival"))
