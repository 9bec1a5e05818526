"""Models of models: ensembles, split conformal bands, per-series selection, hierarchical reconciliation."""

from __future__ import annotations

import re

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, metrics
from ..functions.contract import ID, TARGET, TIME, check_horizon, check_levels, positions, validate_panel
from ..functions.errors import DataContractError
from . import forecaster


def ensemble(forecasts: DataFrame, mode: str = "mean", weights: dict[str, float] | None = None, levels=()) -> DataFrame:
    """Combines long forecasts of several models: mean or median of each column, or signed weights normalised to 1 with
    half-widths weighted by their size."""
    levels = check_levels(levels)
    keys = [ID, "step", TIME]
    bands = [f"{s}_{x}" for x in levels for s in ("lo", "hi")]
    if mode in ("mean", "median"):
        of = F.avg if mode == "mean" else (lambda c: F.percentile(c, F.lit(0.5)))
        return forecasts.groupBy(*keys).agg(*[of(c).alias(c) for c in ("yhat", *bands)])
    if mode != "weighted" or not weights:
        raise ValueError("mode is mean, median, or weighted with weights")
    total = sum(weights.values())
    if abs(total) < 1e-12:
        raise ValueError("weights sum to 0")
    w = F.create_map(*[F.lit(v) for k, x in weights.items() for v in (k, x / total)])[F.col("model")]
    aggs = [F.sum(w * F.col("yhat")).alias("yhat"), *[F.sum(F.abs(w) * (F.col(f"hi_{x}") - F.col(f"lo_{x}")) / 2).alias(f"half_{x}") for x in levels]]
    out = forecasts.groupBy(*keys).agg(*aggs)
    return out.select(*keys, "yhat", *[(F.col("yhat") + sign * F.col(f"half_{x}")).alias(f"{s}_{x}") for x in levels for s, sign in (("lo", -1), ("hi", 1))])


def calibration_split(panel: DataFrame, fraction: float = 0.25, least: int = 8) -> DataFrame:
    """With is_cal: the last max(least, int(fraction n)) rows of each series."""
    placed = positions(panel)
    return placed.withColumn("is_cal", F.col("pos") >= F.col("n") - F.greatest(F.lit(least), F.floor(fraction * F.col("n"))))


def conformal_width(level: int) -> Column:
    """Order statistic of the sorted |residual| array `scores` for a level."""
    n = F.size("scores")
    q = F.least(F.lit(1.0), (n + 1) * (level / 100) / n)
    return F.element_at("scores", (F.ceil(F.round(q * (n - 1), 9)) + 1).cast("int"))


def conformal_bands(forecasts: DataFrame, residuals: DataFrame, levels) -> DataFrame:
    """forecasts with yhat -/+ the conformal width from residuals (unique_id, r)."""
    scores = residuals.groupBy(ID).agg(F.array_sort(F.collect_list(F.abs("r"))).alias("scores"))
    out = forecasts.join(scores, ID)
    widths = {x: conformal_width(x) for x in check_levels(levels)}
    return out.withColumns({f"{s}_{x}": F.col("yhat") + sign * w for x, w in widths.items() for s, sign in (("lo", -1), ("hi", 1))}).drop("scores")


def conformal(panel: DataFrame, model, h: int, level, fraction: float = 0.25, least: int = 8) -> DataFrame:
    """Split conformal: the head's forecast of the held-back rows gives the scores, the whole panel's the centre."""
    panel = validate_panel(panel)
    split = calibration_split(panel, fraction, least)
    if split.filter(~F.col("is_cal")).groupBy(ID).agg(F.count("*").alias("n")).filter("n >= 2").count() < panel.select(ID).distinct().count():
        raise DataContractError("series are too short to hold rows back")
    head, held = split.filter(~F.col("is_cal")), split.filter("is_cal")
    longest = held.groupBy(ID).agg(F.count("*").alias("c")).agg(F.max("c")).first()[0]
    (name, m), = forecaster.resolve([model])
    ahead = forecaster.forecast(head.select(ID, TIME, TARGET), [(name, m)], longest, validate=False)
    step = F.row_number().over(Window.partitionBy(ID).orderBy(TIME)).cast("int")
    r = held.select(ID, TARGET, step.alias("step")).join(ahead.select(ID, "step", "yhat"), [ID, "step"], "left").select(ID, (F.col(TARGET) - F.col("yhat")).alias("r"))
    return conformal_bands(forecaster.forecast(panel, [(name, m)], h, validate=False), r, level)


def choose(scores: DataFrame, order: list[str], metric: str) -> DataFrame:
    """(unique_id, model): the best model of each series; ties go to the first in order; models without a score are out."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("model"))
    v = F.abs("value") if metric in metrics.SIGNED else F.col("value")
    fine = scores.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    return fine.groupBy(ID).agg(F.min_by("model", F.struct(v, rank)).alias("model"), F.min(v).alias("score"))


#: The candidates of auto_select without a season, and those that it has beside seasonal ones.
PLAIN_POOL = ("naive", "drift", "ses", "holt", "theta", "auto_ets", "window_average")
SEASONAL_BASE = ("naive", "drift", "ses", "window_average")
INTERVAL_METRICS = ("coverage", "winkler", "pinball", "wis", "crps")


def default_pool(m: int) -> list:
    """Candidates for a season length."""
    return list(PLAIN_POOL) if m <= 1 else [*SEASONAL_BASE, *[(n, {"season_length": m}) for n in ("seasonal_naive", "theta", "auto_ets")]]


def holdout(panel: DataFrame, models, levels=()) -> DataFrame:
    """Long rows (unique_id, ds, step, y, model, yhat) of each series' own last quarter (one row at least), forecast from the rows before."""
    placed = positions(panel).withColumn("hold", F.greatest(F.lit(1), F.floor(F.col("n") / 4)))
    held = placed.filter(F.col("pos") >= F.col("n") - F.col("hold")).withColumn("step", (F.col("pos") - F.col("n") + F.col("hold") + 1).cast("int"))
    longest = placed.agg(F.max("hold")).first()[0]
    ahead = forecaster.forecast(placed.filter(F.col("pos") < F.col("n") - F.col("hold")).select(ID, TIME, TARGET), models, int(longest), levels, validate=False)
    names = held.sparkSession.createDataFrame([(n,) for n, _ in models], "model string")
    wanted = held.select(ID, TIME, "step", TARGET).crossJoin(F.broadcast(names))  # one row a candidate
    return wanted.join(ahead.drop(TIME), [ID, "model", "step"], "left")


def auto_select(panel: DataFrame, models=None, h: int = 12, level=None, metric: str = "mase", val_h: int = 12, n_windows: int = 2, season_length: int | str | None = "auto") -> tuple[DataFrame, DataFrame]:
    """(forecasts of each series' winner, the winners with their scores).

    Without models the pool depends on the season length; "auto" takes it from the panel's most common step for that pool (and drops
    it where the shortest training slice is no longer than it), and is 1 for given models. Candidates are scored by walk-forward
    cross-validation, or by each series' own 75/25 holdout where the shortest series leaves them too few rows. A candidate with a score for only
    part of the window is out; a series without any score of the metric is ranked by mae, and without that takes the first
    candidate. Only winners are fitted on the whole series."""
    if metric.split("-")[0] in INTERVAL_METRICS:
        raise ValueError(f"{metric!r} needs intervals; candidates are scored by point forecasts")
    if val_h < 1 or n_windows < 1:
        raise ValueError("val_h and n_windows start at 1")
    if isinstance(season_length, str) and season_length != "auto":
        raise ValueError("season_length is a whole number, None or 'auto'")
    panel = validate_panel(panel)
    span = val_h * n_windows
    n = F.col("n")
    r = panel.groupBy(ID).agg(F.count("*").alias("n")).agg(F.min("n").alias("n"), F.min(n - F.greatest(F.lit(1), F.floor(n / 4))).alias("kept")).first()
    auto = season_length == "auto"
    found = (dates.season_of(dates.with_step(panel)) if models is None else 1) if auto else max(1, int(season_length or 1))

    def pool(rows: int):
        """(seasonality of scaled metrics, candidates) for so many training rows."""
        m = 1 if auto and rows <= found else found
        return m if rows > m else 1, forecaster.resolve(models if models is not None else default_pool(m))

    by_cv = r.n > span
    scale, chosen = pool(r.n - span if by_cv else r.kept)
    if by_cv and r.n - span < max(forecaster.least_rows(m) for _, m in chosen) + 1 and r.kept > r.n - span:
        by_cv = False
        scale, chosen = pool(r.kept)
    if by_cv:
        scored = forecaster.cross_validation(panel, chosen, val_h, n_windows, validate=False)
        first = positions(panel).filter(F.col("pos") < n - span).drop("pos", "n")
    else:
        scored = holdout(panel, chosen)
        first = positions(panel).filter(F.col("pos") < n - F.greatest(F.lit(1), F.floor(n / 4))).drop("pos", "n")
    scored = scored.persist(StorageLevel.MEMORY_AND_DISK)
    covered = scored.groupBy(ID, "model").agg(F.count("yhat").alias("k"))
    most = covered.groupBy(ID).agg(F.max("k").alias("most"))
    whole = covered.join(most, ID).filter("k = most").select(ID, "model")
    scores = metrics.evaluate(scored.join(whole, [ID, "model"]), list(dict.fromkeys((metric, "mae"))), first, scale)
    order = [n for n, _ in chosen]
    best, spare = (choose(scores.filter(F.col("metric") == x), order, x).select(ID, F.col("model").alias(f"m_{x}"), F.col("score").alias(f"s_{x}")) for x in (metric, "mae"))
    winners = panel.select(ID).distinct().join(best, ID, "left")
    if metric != "mae":
        winners = winners.join(spare, ID, "left")
    winners = winners.select(ID, F.coalesce(f"m_{metric}", "m_mae", F.lit(order[0])).alias("model"), F.coalesce(f"s_{metric}", "s_mae").alias("score"))
    winners = winners.persist(StorageLevel.MEMORY_AND_DISK)
    winners.count()
    scored.unpersist()
    return forecaster.forecast(panel, chosen, h, level, validate=False, route=winners.select(ID, "model")), winners


# ---- hierarchies -------------------------------------------------------------------------------------------------


def ancestors(ids: DataFrame, sep: str = "/", total: str = "total") -> DataFrame:
    """The summing matrix as edges (leaf, node, depth): each leaf's path prefixes, itself and the total."""
    parts = F.split(ID, re.escape(sep))
    nodes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), sep).alias("node"), i.alias("depth")))
    both = F.concat(F.array(F.struct(F.lit(total).alias("node"), F.lit(0).alias("depth"))), nodes)
    return ids.select(ID).distinct().select(F.col(ID).alias("leaf"), F.explode(both).alias("e")).select("leaf", "e.node", "e.depth")


def check_tree(ids: DataFrame, sep: str = "/", total: str = "total") -> None:
    """Leaves may not be interior nodes, the total's name, or have empty path segments."""
    edges = ancestors(ids, sep, total)
    clash = edges.filter("leaf <> node").select("node").distinct().join(ids.select(F.col(ID).alias("node")).distinct(), "node", "left_semi").limit(3).collect()
    empty = ids.filter(F.array_contains(F.split(ID, re.escape(sep)), "")).limit(1).count()
    if clash or empty:
        raise DataContractError(f"ids are no tree of leaves: {[r[0] for r in clash] or 'an empty path segment'}")


def aggregate_panel(panel: DataFrame, sep: str = "/", total: str = "total") -> DataFrame:
    """Sums over every path prefix and the grand total, with the leaves."""
    edges = ancestors(panel, sep, total)
    return panel.join(edges.withColumnRenamed("leaf", ID), ID).groupBy(F.col("node").alias(ID), TIME).agg(F.sum(TARGET).alias(TARGET))


def _tree(ids: DataFrame, sep: str, total: str) -> DataFrame:
    """(node, depth, parent) of every node; the total's parent is null."""
    nodes = ancestors(ids, sep, total).select("node", "depth").distinct()
    above = F.when(F.col("depth") == 1, F.lit(total)).when(F.col("depth") > 1, F.expr(f"substring_index(node, '{sep}', depth - 1)"))
    return nodes.withColumn("parent", above)


def _mint(forecasts: DataFrame, tree: DataFrame) -> DataFrame:
    """(node, step, x): the coherent values nearest to the forecasts of all nodes in least squares, by two sweeps over the tree.

    Upwards, a subtree's least squared change for a total x is a (x - m)^2 + constant: a leaf has a = 1 and its forecast as m, and a node
    adds its own square to what its children cost together, (x - sum m)^2 / sum(1 / a). Downwards, each child gets its m and its share of
    what the parent's value has over the sum of these. So the work is linear in the nodes, one join a level."""
    keep = lambda frame: frame.persist(StorageLevel.DISK_ONLY)
    depth = tree.agg(F.max("depth")).first()[0]
    rows = keep(tree.join(forecasts.select(F.col(ID).alias("node"), "step", "yhat"), "node"))
    at = lambda d: rows.filter(F.col("depth") == d).select("node", "parent", "step", "yhat")
    none = F.lit(None).cast("double")
    solved = {depth: at(depth).select("node", "parent", "step", F.lit(1.0).alias("a"), F.col("yhat").alias("m"), none.alias("sum_m"), none.alias("slack"))}
    for d in range(depth - 1, -1, -1):
        below = solved[d + 1].groupBy(F.col("parent").alias("node"), "step").agg(F.sum("m").alias("sum_m"), F.sum(1 / F.col("a")).alias("slack"))
        own = at(d).join(below, ["node", "step"], "left")
        a = F.coalesce(1 + 1 / F.col("slack"), F.lit(1.0))
        m = F.coalesce((F.col("yhat") + F.col("sum_m") / F.col("slack")) / (1 + 1 / F.col("slack")), F.col("yhat"))
        solved[d] = keep(own.select("node", "parent", "step", a.alias("a"), m.alias("m"), "sum_m", "slack"))
    now = solved[0].select("node", "step", F.col("m").alias("x"), "sum_m", "slack")
    out = now.select("node", "step", "x")
    for d in range(1, depth + 1):
        above = now.select(F.col("node").alias("parent"), "step", ((F.col("x") - F.col("sum_m")) / F.col("slack")).alias("each"))
        below = solved[d].join(above, ["parent", "step"]).select("node", "step", (F.col("m") + F.col("each") / F.col("a")).alias("x"), "sum_m", "slack")
        now = keep(below) if d < depth else below
        out = out.unionByName(now.select("node", "step", "x"))
    return out


def reconcile(forecasts: DataFrame, history: DataFrame, method: str = "mint_ols", sep: str = "/", total: str = "total") -> DataFrame:
    """Coherent (unique_id, step, yhat) of all nodes. forecasts has leaves (bottom_up), leaves and total (top_down) or every node
    (mint_ols)."""
    edges = ancestors(history, sep, total)
    up = lambda leaves: leaves.join(edges, leaves[ID] == edges["leaf"]).groupBy(F.col("node").alias(ID), "step").agg(F.sum("yhat").alias("yhat"))
    leaves = forecasts.join(history.select(ID).distinct(), ID, "left_semi")
    if method == "bottom_up":
        return up(leaves.select(ID, "step", "yhat"))
    if method == "top_down":
        sums = leaves.groupBy("step").agg(F.sum("yhat").alias("s"), F.sum(F.abs("yhat")).alias("a"), F.count("*").alias("n"))  # a row a step
        top = forecasts.filter(F.col(ID) == total).select("step", F.col("yhat").alias("top")).join(sums, "step")
        flat = F.abs("s") < F.greatest(1e-8 * F.col("a"), F.lit(1e-12))
        share = F.when(flat, 1.0 / F.col("n")).otherwise(F.try_divide(F.col("yhat"), F.col("s")))
        return up(leaves.select(ID, "step", "yhat").join(top, "step").select(ID, "step", (share * F.col("top")).alias("yhat")))
    if method != "mint_ols":
        raise ValueError("method is bottom_up, top_down or mint_ols")
    return _mint(forecasts, _tree(history, sep, total)).select(F.col("node").alias(ID), "step", F.col("x").alias("yhat"))


def reconciled(panel: DataFrame, model, h: int, method: str = "mint_ols", sep: str = "/", total: str = "total", level=None) -> DataFrame:
    """Forecasts every node and reconciles point and bounds; bounds are then put in order around the point."""
    h, levels = check_horizon(h), check_levels(level)
    check_tree(panel, sep, total)
    # each column's sweeps read them: kept on the executors' disks until the session clears its cache
    f = forecaster.forecast(aggregate_panel(panel, sep, total), [model], h, levels, validate=False).persist(StorageLevel.DISK_ONLY)
    out = reconcile(f, panel, method, sep, total)
    for x in reversed(levels):
        for s in ("lo", "hi"):
            b = reconcile(f.select(ID, "step", F.col(f"{s}_{x}").alias("yhat")), panel, method, sep, total).withColumnRenamed("yhat", f"{s}_{x}")
            out = out.join(b, [ID, "step"])
    last: tuple[Column, Column] = (F.col("yhat"), F.col("yhat"))
    change = {}
    for x in levels:  # nested outward
        last = (F.least(F.col(f"lo_{x}"), F.col(f"hi_{x}"), last[0]), F.greatest(F.col(f"lo_{x}"), F.col(f"hi_{x}"), last[1]))
        change |= {f"lo_{x}": last[0], f"hi_{x}": last[1]}
    return out.withColumns(change).join(f.select(ID, "step", TIME).distinct(), [ID, "step"])
