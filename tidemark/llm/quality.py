"""Quality rules: word statistics, two base rules, and robust multivariate outliers. DataFrame functions throughout.

Each language and source has a minimum-covariance-determinant estimate of location and scatter over its texts that pass the base
rules: of the means and covariances of half of the rows (h = (n + p + 1) // 2) that concentration reaches, the one of the
smallest determinant. It starts from the medians with three scatters: squared spreads, the correlation of hyperbolic tangents of
standardised values, and of their spatial signs. A concentration step refits each start on the h rows that lie nearest by its
Mahalanobis distance, and a start goes on until its determinant stops falling. The h nearest are found from counts of log-distance
bins; the bin in which the h-th lies counts in part, so that the weights sum to h. So no group is ever gathered or sorted in a task.

The smallest determinant's scatter is made consistent, location and scatter are refitted once on the rows within INNER, made
consistent again, and rows beyond CUTOFF (36: the 0.975 quantile is 11.14; clean texts of a skewed statistic stay) are rejected. A
small prior variance is part of every scatter and determinant, as in most groups half of the texts have none of a statistic; with it, a
single symbol or repeated line in a clean group rejects nothing.

Groups of fewer than SMALL_GROUP passing rows are estimated with their language's other small groups, and if those are few
too, with all such. Null language and source are groups of their own (the empty name). Null text has no words and fails the base
rules. Texts of any length are read whole. Repeated rows and null ids count and are judged one by one; extra columns are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SPACE = r"[\x20\x09-\x0D]+"
SMALL_GROUP, MOST_STEPS = 50, 40
#: Squared distances: the 0.975 quantile of chi-square with four degrees of freedom, and that beyond which rows are rejected.
INNER, CUTOFF = 11.143, 36.0
FEATURES = ("x0", "x1", "x2", "x3")
PRIOR = (0.04, 0.02, 0.04, 0.02)
BINS = 24


def _even_chi2(x: float, half: int) -> float:
    """Distribution function of chi-square with 2 half degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(half))


def consistency(inner: float) -> float:
    """What the scatter of normal rows within a squared distance falls short by, in four dimensions."""
    return _even_chi2(inner, 2) / _even_chi2(inner, 3)


#: The median of chi-square with four degrees of freedom.
HALF = 3.35669


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base statistics of each row."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"),
        F.array_remove(F.split(F.coalesce("text", F.lit("")), SPACE), "").alias("words"),
        F.coalesce(F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]+", "")), F.lit(0)).cast("long").alias("n_symbols"),
        F.coalesce(F.length(F.regexp_replace("text", SPACE, "")), F.lit(0)).cast("long").alias("word_chars"),
        lines.alias("lines"),
    )
    keep = ["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines"]
    w = F.col("words")
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    step = step.select(
        "doc_id", "lang", "source", F.size(w).cast("long").alias("n_words"), "word_chars", "n_symbols",
        F.coalesce(F.size("lines") - F.size(F.array_distinct("lines")), F.lit(0)).cast("long").alias("n_dup_lines"),
        F.when(F.size(w) >= 3, windows).otherwise(F.array().cast("array<bigint>")).alias("h"),
    )
    step = step.select(*keep, "h", F.size(F.array_distinct("h")).alias("distinct"))
    placed = F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    step = step.select(*keep, F.when(F.size("h") > F.col("distinct"), placed).otherwise(F.array().cast("array<struct<x:bigint,i:int>>")).alias("s"))
    s = F.col("s")
    twin = lambda e, k: F.coalesce(e["x"] == F.get(s, k - 1)["x"], F.lit(False)) | F.coalesce(e["x"] == F.get(s, k + 1)["x"], F.lit(False))
    covered = F.array_distinct(F.flatten(F.transform(F.filter(s, twin), lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2))))
    return step.select(*keep, F.size(covered).cast("long").alias("n_repeat_words"))


def _vector(n_words: Column, word_chars: Column, n_symbols: Column, n_dup_lines: Column, n_repeat: Column) -> list[Column]:
    """Transformed statistics: word length and rates a word, in log scale."""
    n = F.greatest(n_words, F.lit(1)).cast("double")
    return [F.log(F.greatest(word_chars / n, F.lit(0.1))), F.log1p(4 * n_symbols / n), F.log1p(20 * n_dup_lines / n), F.log1p(4 * n_repeat / n)]


P = len(FEATURES)
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def _fit(rows: DataFrame, keys=("grp",), weight: Column | None = None) -> DataFrame:
    """Mean m_i, covariance c_ij and Cholesky factor l_ij (of the covariance plus the prior) of each group of rows, weighted."""
    w = F.lit(1.0) if weight is None else weight
    mass, part = F.sum(w), lambda c: F.sum(w * c) / F.sum(w)
    sums = [mass.alias("mass"), *[part(F.col(x)).alias(f"m{i}") for i, x in enumerate(FEATURES)], *[part(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"a{i}{j}") for i, j in PAIRS]]
    centred = [(F.col(f"a{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")).alias(f"c{i}{j}") for i, j in PAIRS]
    return _factored(rows.groupBy(*keys).agg(*sums).select(*keys, *[f"m{i}" for i in range(P)], *centred))


def _factored(fit: DataFrame, scale: float = 1.0) -> DataFrame:
    """fit with the factor of scale times its covariance plus the prior, and its determinant."""
    for i in range(P):
        for j in range(i + 1):
            rest = F.lit(scale) * F.col(f"c{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            fit = fit.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest + PRIOR[i], F.lit(PRIOR[i] / 2))) if i == j else rest / F.col(f"l{j}{j}"))
    det = F.lit(1.0)
    for i in range(P):
        det = det * F.col(f"l{i}{i}") * F.col(f"l{i}{i}")
    return fit.withColumn("det", det)


def _distance() -> Column:
    p, solved = len(FEATURES), []
    for i in range(p):
        solved.append((F.col(FEATURES[i]) - F.col(f"m{i}") - sum((F.col(f"l{i}{k}") * solved[k] for k in range(i)), F.lit(0.0))) / F.col(f"l{i}{i}"))
    return sum((y * y for y in solved), F.lit(0.0))


def _bin() -> Column:
    return F.floor(F.log(_distance() + 1e-6) * BINS)


def starts(rows: DataFrame, groups: int) -> DataFrame:
    """(grp, start, m, c, l): medians with three scatters, and n rows of each group."""
    quartiles = lambda x, i: F.percentile_approx(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 1000).alias(f"q{i}")
    mid = rows.groupBy("grp").agg(F.count("*").alias("n"), *[quartiles(x, i) for i, x in enumerate(FEATURES)])
    scale = lambda i: F.sqrt(F.pow((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, 2) + PRIOR[i])
    mid = common.staged(mid.select("grp", "n", *[F.col(f"q{i}")[1].alias(f"m{i}") for i in range(P)], *[scale(i).alias(f"s{i}") for i in range(P)]), "mcd", groups)
    z = rows.join(common.small(mid, groups), "grp").select("grp", *[((F.col(x) - F.col(f"m{i}")) / F.col(f"s{i}")).alias(f"z{i}") for i, x in enumerate(FEATURES)])
    size = F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(P)), F.lit(1e-12)))
    z = z.select("grp", *[F.tanh(f"z{i}").alias(f"t{i}") for i in range(P)], *[(F.col(f"z{i}") / size).alias(f"g{i}") for i in range(P)])
    sums = [F.avg(f"t{i}").alias(f"at{i}") for i in range(P)] + [F.avg(F.col(f"{k}{i}") * F.col(f"{k}{j}")).alias(f"{k}{i}{j}") for k in "tg" for i, j in PAIRS]
    moments = z.groupBy("grp").agg(*sums).join(mid, "grp")

    def scatter(start: int, i: int, j: int) -> Column:
        if i == j:
            return F.pow(F.col(f"s{i}"), 2) - PRIOR[i]
        if start == 0:
            return F.lit(0.0)
        of = (lambda a, b: F.col(f"t{a}{b}") - F.col(f"at{a}") * F.col(f"at{b}")) if start == 1 else (lambda a, b: F.col(f"g{a}{b}"))
        return F.coalesce(F.try_divide(of(i, j), F.sqrt(of(i, i) * of(j, j))), F.lit(0.0)) * F.col(f"s{i}") * F.col(f"s{j}")

    each = F.array(*[F.struct(F.lit(k).alias("start"), *[scatter(k, i, j).alias(f"c{i}{j}") for i, j in PAIRS]) for k in range(3)])
    rows = moments.select("grp", "n", *[f"m{i}" for i in range(P)], F.explode(each).alias("e")).select("grp", "n", *[f"m{i}" for i in range(P)], "e.*")
    return _factored(rows).withColumn("det", F.lit(float("inf")))


def concentrated(rows: DataFrame, fit: DataFrame, fits: int) -> DataFrame:
    """(grp, start, m, c, l, det): each fit's successor, of the h rows of its group that lie nearest to it."""
    near = rows.join(common.small(fit, fits), "grp")
    counts = near.groupBy("grp", "start", _bin().alias("bin")).agg(F.count("*").alias("k"))
    # at most a few hundred bins a fit
    order = "partition by grp, start order by bin rows between unbounded preceding and current row"
    upto = counts.withColumn("upto", F.expr(f"sum(k) "
        f"over ({order})")).join(fit.select("grp", "start", F.floor((F.col("n") + P + 1) / 2).alias("h")), ["grp", "start"])
    last = upto.filter("upto >= h").groupBy("grp", "start").agg(F.min("bin").alias("last"), F.min_by((F.col("h") - F.col("upto") + F.col("k")) / F.col("k"), "bin").alias("part"))
    cut = common.staged(fit.join(last, ["grp", "start"]), "mcd", fits)
    weight = F.when(F.col("bin") < F.col("last"), 1.0).when(F.col("bin") == F.col("last"), F.col("part"))
    inside = rows.join(common.small(cut, fits), "grp").withColumn("bin", _bin()).select("grp", "start", *FEATURES, weight.alias("weight")).filter("weight > 0")
    return _fit(inside, ("grp", "start"), F.col("weight"))


def determinants(rows: DataFrame) -> DataFrame:
    """(grp, start, n, m, c, l, det) of each start when its determinant has stopped falling. A table."""
    groups = rows.select("grp").distinct().count()
    best = common.staged(starts(rows, groups).withColumn("open", F.lit(True)), "mcd", 3 * groups)
    for _ in range(MOST_STEPS):
        fit = best.filter("open").drop("open")
        if not (left := fit.count()):
            return best
        after = concentrated(rows, fit, left)
        changed = [c for c in after.columns if c not in ("grp", "start")]
        both = best.join(after.select("grp", "start", *[F.col(c).alias(f"new_{c}") for c in changed]), ["grp", "start"], "left")
        falls = F.coalesce(F.col("new_det") < F.col("det") * (1 - 1e-6), F.lit(False))
        best = common.staged(both.select("grp", "start", "n", *[F.when(falls, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in changed], falls.alias("open")), "mcd", 3 * groups)
    return best


def estimates(rows: DataFrame) -> DataFrame:
    """The final fit of each grp of rows (grp, x0 ... x3)."""
    found = determinants(rows)
    fits = [c for c in found.columns if c not in ("grp", "open")]
    best = found.groupBy("grp").agg(F.min_by(F.struct(*fits), F.struct("det", "start")).alias("b")).select("grp", *[f"b.{c}" for c in fits if c[0] in "mc"])
    groups = best.count()
    best = common.staged(_factored(best, consistency(HALF)), "mcd", groups)
    within = rows.join(common.small(best, groups), "grp").filter(_distance() <= INNER).select("grp", *FEATURES)
    last = _fit(within).select("grp", *[f"m{i}" for i in range(P)], *[f"c{i}{j}" for i, j in PAIRS])
    return common.staged(_factored(last, consistency(INNER)), "mcd", groups)


def judge(docs: DataFrame) -> DataFrame:
    stats = statistics(docs)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    x = _vector(*[F.col(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")])
    stats = common.staged(stats.select("*", base.alias("base_failed"), *[c.alias(f) for c, f in zip(x, FEATURES)]), "quality")
    sizes = stats.filter(~F.col("base_failed")).groupBy("lang", "source").agg(F.count("*").alias("n"))  # a row a language and source
    few = F.col("n") < SMALL_GROUP
    whole = sizes.withColumn("left", F.expr(f"sum(case when n < {SMALL_GROUP} then n end) over (partition by lang)"))
    name = F.when(~few, F.concat(F.lit("g:"), "lang", F.lit("\t"), "source")).when(F.col("left") >= SMALL_GROUP, F.concat(F.lit("l:"), "lang")).otherwise(F.lit("all"))
    groups = common.settled(whole.select("lang", "source", name.alias("grp")), "groups")
    rows = common.held(stats.filter(~F.col("base_failed")).join(common.small(groups, groups.rows), ["lang", "source"]).select("grp", *FEATURES))
    fit = groups.join(estimates(rows), "grp").drop("grp", "det")
    rows.unpersist()
    out = stats.join(common.small(fit, groups.rows), ["lang", "source"], "left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(True))).alias("kept"), F.round("distance", 3).alias("distance"),
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.read(spark, sf_dir, "documents"))
