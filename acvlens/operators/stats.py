"""Statistics behind the reference's plots, as Spark jobs producing plot data.

Every operator is generic over a group key and a value column and runs as
grouped aggregates: partial aggregation map-side, one shuffle on the group
key, and small per-group results joined back where a second pass is needed.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

# Even ranks at which a wide bracket of a quantile is sketched to narrow it.
GRID = 512


def _null_safe_on(left: str, right: str, keys: Sequence[str]) -> Column | None:
    cond = None
    for k in keys:
        c = F.col(f"{left}.`{k}`").eqNullSafe(F.col(f"{right}.`{k}`"))
        cond = c if cond is None else cond & c
    return cond


def _join_group_stats(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach one-row-per-group statistics to every row of ``df``.

    ``stats`` has one row per group; AQE broadcasts it when the measured
    size is small and sort-merges otherwise.
    """
    if not keys:
        # A single global group: ``stats`` is exactly one row, so broadcasting
        # it has a proven size bound (a sort-merge join on a constant key would
        # put every row in one task).
        d = df.withColumn("__g", F.lit(0)).alias("__d")
        s = F.broadcast(stats.withColumn("__g", F.lit(0))).alias("__s")
        return d.join(s, F.col("__d.__g") == F.col("__s.__g"), "inner").select(
            "__d.*", *[F.col(f"__s.`{c}`") for c in stats.columns]).drop("__g")
    d, s = df.alias("__d"), stats.alias("__s")
    extra = [c for c in stats.columns if c not in keys]
    return d.join(s, _null_safe_on("__d", "__s", keys), "inner").select(
        *[F.col(f"__d.`{c}`") for c in df.columns], *[F.col(f"__s.`{c}`") for c in extra])


# --- quantiles / box plot -------------------------------------------------------

def group_quantiles(df: DataFrame, group_cols: Sequence[str], value_col: str,
                    probs: Sequence[float], names: Sequence[str], accuracy: int = 10000,
                    midpoint: bool = False, extra_aggs: Sequence[Column] = (),
                    exact: bool = True, most: int | None = None) -> DataFrame:
    """Exact quantiles per group (R type 7) without gathering a group in one task.

    For each probability p the target ranks are floor(h) and ceil(h) with
    h = (n - 1)·p + 1, and a bracket of values holds both; it is narrowed until at
    most ``most`` distinct values (10·accuracy by default, at least 2·accuracy and 2·``GRID``) lie in it.  At first it is the whole group.  If that is too
    many, a bounded ``percentile_approx`` sketch per group (merged map-side, taken in the
    pass that counts the rows) gives the bracket: its answers at p ± 2/accuracy enclose
    the ranks, because its rank error is at most n/accuracy.  Brackets that are
    still too wide are narrowed by further passes: each counts the rows below and inside and
    sketches the inside at ``GRID`` even ranks, of which those around the target are the next
    bracket.  The last pass keeps the values inside as (value, count) pairs, and the ranks are resolved
    from running counts over those alone: a rank task of a group and probability holds at most ``most`` values.
    (Only where nearly all rows inside equal its two ends can a bracket stay wider.)  The
    per-group statistics of each pass are written, and one number is read from them to see whether another pass is
    needed.  A rank outside its bracket (a sketch off by more than its bound) is an error.

    ``midpoint=True`` gives ``(x[lo] + x[hi]) / 2`` (R's ``median``) instead of
    ``(1 - f)·x[lo] + f·x[hi]`` (R's ``quantile``).  ``extra_aggs`` (over the
    value column renamed ``__v``) are computed in the sketch pass and returned
    alongside, saving a separate aggregation over the rows.  ``exact=False``
    is the opt-in approximate form: one pass, the sketch's answer at each p
    (rank error at most n/accuracy).
    """
    g = list(group_cols)
    most = max(10 * accuracy if most is None else most, 2 * accuracy, 2 * GRID)   # below that a sketch's ranks are off by less than a row
    if not exact:
        a = df.select(*g, F.col(value_col).cast("double").alias("__v")).where("__v IS NOT NULL") \
              .groupBy(*g).agg(F.percentile_approx("__v", list(probs), accuracy).alias("__a"), *extra_aggs)
        extra = [c for c in a.columns if c not in (*g, "__a")]
        return a.select(*g, *[F.col("__a")[i].alias(nm) for i, nm in enumerate(names)], *extra)
    gq = [f"`{c}`" for c in g]
    part = f"PARTITION BY {', '.join(gq)}" if g else ""
    probs = list(probs)
    k = range(len(probs))
    base = df.select(*g, F.col(value_col).cast("double").alias("__v")).where("__v IS NOT NULL")
    eps = 2.0 / accuracy
    bp = []
    for p in probs:
        bp += [max(0.0, p - eps), min(1.0, p + eps)]
    sk = base.groupBy(*g).agg(
        F.expr("count(1) AS __n"),
        F.expr(f"percentile_approx(__v, array({', '.join(f'{b!r}D' for b in bp)}), {accuracy}) AS __b"),
        *extra_aggs)
    extra = [c for c in sk.columns if c not in (*g, "__n", "__b")]
    small = f"__n <= {most}"
    cols = [*gq, "__n"]
    for i, p in enumerate(probs):
        h = f"(CAST(__n - 1 AS DOUBLE) * {p!r}D + 1.0D)"
        cols += [f"CASE WHEN {small} THEN CAST('-Infinity' AS DOUBLE) ELSE __b[{2 * i}] END AS __lo{i}",
                 f"CASE WHEN {small} THEN CAST('Infinity' AS DOUBLE) ELSE __b[{2 * i + 1}] END AS __hi{i}",
                 f"floor({h}) AS __klo{i}", f"ceil({h}) AS __khi{i}", f"{h} - floor({h}) AS __f{i}"]
    sk = _narrowed(base, materialize(sk.selectExpr(*cols, *extra)), g, len(probs), accuracy, most)
    stat_cols = [c for c in sk.columns if c not in g and c not in extra]
    j = _join_group_stats(base, sk, g)
    in_any = " OR ".join(f"(__v >= __lo{i} AND __v <= __hi{i})" for i in k)
    # One row per candidate value, plus one row per group for everything else.
    t = j.groupBy(*g, F.expr(f"CASE WHEN {in_any} THEN __v END AS __cv")).agg(
        F.expr("count(1) AS __w"),
        *[F.expr(f"first({c}) AS {c}") for c in stat_cols + extra],
        *[F.expr(f"count_if(__v < __lo{i}) AS __below{i}") for i in k])
    inside = [f"(__cv IS NOT NULL AND __cv >= __lo{i} AND __cv <= __hi{i})" for i in k]
    # Rank of the last copy of each candidate value: rows below the bracket
    # plus the running count of candidates inside it.
    t = t.selectExpr("*", *[
        f"sum(__below{i}) OVER ({part}) + sum(CASE WHEN {inside[i]} THEN __w ELSE 0 END) OVER "
        f"({part} ORDER BY __cv ASC NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS __end{i}"
        for i in k])
    picks = []
    for i in k:
        picks += [f"sum(__below{i}) AS __under{i}", f"max(CASE WHEN {inside[i]} THEN __end{i} END) AS __reach{i}",
                  f"first(__klo{i}) AS __klo{i}", f"first(__khi{i}) AS __khi{i}",
                  f"min(CASE WHEN {inside[i]} AND __end{i} >= __klo{i} THEN __cv END) AS __xlo{i}",
                  f"min(CASE WHEN {inside[i]} AND __end{i} >= __khi{i} THEN __cv END) AS __xhi{i}",
                  f"first(__f{i}) AS __f{i}"]
    r = t.groupBy(*g).agg(*[F.expr(x) for x in picks], *[F.expr(f"first({c}) AS {c}") for c in extra])
    # The ranks must lie inside the bracket: a wrong sketch stops the job rather than giving a wrong quantile.
    held = " AND ".join(f"__under{i} < __klo{i} AND __khi{i} <= __reach{i}" for i in k)
    r = r.withColumn("__xlo0", F.expr(f"CASE WHEN {held} THEN __xlo0 ELSE CAST(raise_error("
                                      "'a quantile lies outside its sketched bracket') AS DOUBLE) END"))
    if midpoint:
        outs = [f"(__xlo{i} + __xhi{i}) / 2.0D AS `{nm}`" for i, nm in enumerate(names)]
    else:
        outs = [f"CASE WHEN __f{i} = 0 THEN __xlo{i} ELSE (1.0D - __f{i}) * __xlo{i} + __f{i} * __xhi{i} END AS `{nm}`"
                for i, nm in enumerate(names)]
    return r.selectExpr(*gq, *outs, *extra)


def _narrowed(base: DataFrame, brackets: DataFrame, g: list[str], n_probs: int, accuracy: int, most: int) -> DataFrame:
    """``brackets`` (per group __n, and per probability __lo, __hi, __klo, __khi), narrowed to ``most`` distinct values each.

    A pass is made only if some bracket may hold more: of n rows, a first bracket holds about 4·n/accuracy.
    """
    k, names = range(n_probs), brackets.columns
    most_rows = brackets.agg(F.max("__n")).first()[0] or 0
    if most_rows <= most or (4.0 / accuracy) * most_rows + 2 <= most:
        return brackets
    margin = math.ceil(2 * GRID / accuracy) + 1
    ranks = ", ".join(f"{i / GRID!r}D" for i in range(GRID + 1))
    while True:
        j = _join_group_stats(base, brackets.select(*g, *[f"__{e}{i}" for i in k for e in ("lo", "hi")]), g)
        inside = [f"(__v >= __lo{i} AND __v <= __hi{i})" for i in k]
        counted = j.groupBy(*g).agg(*[F.expr(x) for i in k for x in (
            f"count_if(__v < __lo{i}) AS __below{i}", f"count_if({inside[i]}) AS __m{i}",
            f"approx_count_distinct(CASE WHEN {inside[i]} THEN __v END) AS __d{i}",
            f"percentile_approx(CASE WHEN {inside[i]} THEN __v END, array({ranks}), {accuracy}) AS __grid{i}")])
        held = _join_group_stats(brackets, counted, g)
        cols = {}
        for i in k:
            # Where the target ranks lie among the grid's, and the grid's values around them.
            low = f"(CAST(floor((__klo{i} - __below{i} - 1) * {GRID}D / __m{i}) AS int) - {margin})"
            high = f"(CAST(ceil((__khi{i} - __below{i}) * {GRID}D / __m{i}) AS int) + {margin})"
            wide = f"__d{i} > {most}"
            cols[f"__lo{i}"] = f"CASE WHEN {wide} AND {low} >= 0 THEN get(__grid{i}, {low}) ELSE __lo{i} END"
            cols[f"__hi{i}"] = f"CASE WHEN {wide} AND {high} <= {GRID} THEN get(__grid{i}, {high}) ELSE __hi{i} END"
        changed = " OR ".join(f"__lo{i}_ != __lo{i} OR __hi{i}_ != __hi{i}" for i in k)
        held = held.withColumns({f"{c}_": F.expr(x) for c, x in cols.items()}).withColumn("__changed", F.expr(changed))
        held = materialize(held.select(*[F.col(f"{c}_").alias(c) if c in cols else F.col(f"`{c}`")
                                         for c in names], "__changed"))
        again = held.where("__changed").limit(1).count() > 0
        brackets = held.drop("__changed")
        if not again:
            return brackets


def median_exact(df: DataFrame, group_cols: Sequence[str], value_col: str,
                 alias: str = "median") -> DataFrame:
    """Exact median per group, ``(x[lo] + x[hi]) / 2`` in double like R's ``median``."""
    return group_quantiles(df, group_cols, value_col, [0.5], [alias], midpoint=True)


def boxplot_stats(df: DataFrame, group_cols: Sequence[str], value_col: str,
                  coef: float = 1.5) -> DataFrame:
    """``geom_boxplot`` statistics per group.

    Quartiles by R type 7; values outside [q1 - coef·IQR, q3 + coef·IQR] are
    outliers.  With no outlier the whiskers are the minimum and maximum; with
    outliers they are the range of the quartiles together with the values
    inside the fences (so a whisker never falls inside the box).  The
    per-group statistics are joined back to the rows (one row per group:
    AQE broadcasts it when small) for the whisker pass.
    """
    g = list(group_cols)
    v = F.col(value_col).cast("double")
    base = df.select(*g, v.alias("__v")).filter(F.col("__v").isNotNull())
    q = group_quantiles(base, g, "__v", [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    iqr = F.col("q3") - F.col("q1")
    q = q.withColumn("lower_fence", F.col("q1") - coef * iqr) \
         .withColumn("upper_fence", F.col("q3") + coef * iqr)
    j = _join_group_stats(base, q, g)
    inside = (F.col("__v") >= F.col("lower_fence")) & (F.col("__v") <= F.col("upper_fence"))
    s = j.groupBy(*g).agg(
        F.count(F.lit(1)).alias("n"),
        F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.min(F.when(inside, F.col("__v"))).alias("__lo"),
        F.max(F.when(inside, F.col("__v"))).alias("__hi"),
        F.count_if(~inside).cast("long").alias("n_outliers"),
    )
    return s.select(*g, "n", "q1", "median", "q3",
                    F.least("q1", "__lo").alias("lower_whisker"),
                    F.greatest("q3", "__hi").alias("upper_whisker"), "n_outliers")


def boxplot_outliers(df: DataFrame, group_cols: Sequence[str], value_col: str,
                     keep_cols: Sequence[str] = (), coef: float = 1.5) -> DataFrame:
    """The rows drawn as outlier points of ``geom_boxplot``."""
    g = list(group_cols)
    base = df.select(*g, *[c for c in keep_cols if c not in g],
                     F.col(value_col).cast("double").alias(value_col)) \
             .filter(F.col(value_col).isNotNull())
    q = group_quantiles(base, g, value_col, [0.25, 0.75], ["q1", "q3"])
    iqr = F.col("q3") - F.col("q1")
    q = q.select(*g, (F.col("q1") - coef * iqr).alias("lower_fence"),
                 (F.col("q3") + coef * iqr).alias("upper_fence"))
    j = _join_group_stats(base, q, g)
    out = (F.col(value_col) < F.col("lower_fence")) | (F.col(value_col) > F.col("upper_fence"))
    return j.filter(out).drop("lower_fence", "upper_fence")


# --- kernel density -------------------------------------------------------------

def _bw_nrd0(n: Column, sd: Column, iqr: Column, xmin: Column) -> Column:
    """R's ``bw.nrd0``: 0.9 · min(sd, IQR/1.34) · n^-0.2, with its fallbacks.

    When the spread is 0 R falls back to the sd, then to |first value|, then
    to 1.  The sd is 0 only when all values are equal, so |first value| is
    |min| and the rule stays deterministic.
    """
    lo = F.least(sd, iqr / F.lit(1.34))
    lo = F.when(lo > 0, lo).when(sd > 0, sd).when(F.abs(xmin) > 0, F.abs(xmin)).otherwise(F.lit(1.0))
    return F.lit(0.9) * lo * F.pow(n.cast("double"), F.lit(-0.2))


def density(df: DataFrame, group_cols: Sequence[str], value_col: str, n_grid: int = 512,
            binned: bool = True, adjust: float = 1.0) -> DataFrame:
    """Gaussian kernel density per group on ``n_grid`` points from min to max.

    Bandwidth ``bw.nrd0``; groups with fewer than two values are dropped (as
    ``geom_density`` does).  ``binned=True`` (default) linearly bins the values
    onto the grid first, as R's ``density`` does, and convolves each group's bin weights
    with the kernel as arrays: a group is one row of at most n_grid bins however many rows it has.
    ``binned=False`` sums the kernel over every value (n_rows × n_grid terms).
    """
    g = list(group_cols)
    v = F.col(value_col).cast("double")
    base = df.select(*g, v.alias("__v")).filter(F.col("__v").isNotNull())
    st = group_quantiles(base, g, "__v", [0.25, 0.75], ["__q1", "__q3"], extra_aggs=[
        F.count(F.lit(1)).alias("__cnt"), F.stddev_samp("__v").alias("__sd"),
        F.min("__v").alias("__from"), F.max("__v").alias("__to")])
    st = st.withColumnRenamed("__cnt", "__n").filter(F.col("__n") >= 2)
    st = st.select(
        *g, "__n", "__from", "__to",
        (F.lit(adjust) * _bw_nrd0(F.col("__n"), F.col("__sd"), F.col("__q3") - F.col("__q1"),
                                  F.col("__from"))).alias("__bw"),
        ((F.col("__to") - F.col("__from")) / F.lit(n_grid - 1)).alias("__delta"),
    )
    j = _join_group_stats(base, st, g)
    gstats = ["__n", "__from", "__delta", "__bw"]
    if binned:
        t = F.when(F.col("__delta") > 0, (F.col("__v") - F.col("__from")) / F.col("__delta")) \
             .otherwise(F.lit(0.0))
        lo = F.least(F.floor(t), F.lit(n_grid - 1)).cast("int")
        j = j.select(*g, *gstats, lo.alias("__lo"), (t - F.floor(t)).alias("__f"))
        parts = F.explode(F.array(
            F.struct(F.col("__lo").alias("b"), (F.lit(1.0) - F.col("__f")).alias("w")),
            F.struct(F.least(F.col("__lo") + 1, F.lit(n_grid - 1)).alias("b"),
                     F.col("__f").alias("w"))))
        pts = (j.select(*g, *gstats, parts.alias("__p"))
                .filter(F.col("__p.w") > 0)
                .groupBy(*g, *gstats, F.col("__p.b").alias("__b"))
                .agg(F.sum("__p.w").alias("__w")))
        return _convolved(pts, g, n_grid)
    pts = j.select(*g, *gstats, F.col("__v").alias("__x"), F.lit(1.0).alias("__w"))
    grid = F.explode(F.sequence(F.lit(0), F.lit(n_grid - 1))).alias("__j")
    z = ((F.col("__from") + F.col("__j") * F.col("__delta")) - F.col("__x")) / F.col("__bw")
    k = F.col("__w") * F.exp(F.lit(-0.5) * z * z) / (F.lit(math.sqrt(2 * math.pi)) * F.col("__bw") * F.col("__n"))
    terms = pts.select(*g, *gstats, "__x", "__w", grid).select(*g, *gstats, "__j", k.alias("__k"))
    out = terms.groupBy(*g, "__j").agg(
        F.first("__from").alias("__from"), F.first("__delta").alias("__delta"),
        F.first("__bw").alias("bw"), F.first("__n").alias("n"), F.sum("__k").alias("density"))
    return out.select(*g, F.col("__j").cast("long").alias("grid_index"),
                      (F.col("__from") + F.col("__j") * F.col("__delta")).alias("x"),
                      "density", "bw", "n")


def _convolved(bins: DataFrame, g: list[str], n_grid: int) -> DataFrame:
    """Density at every grid point from a group's bin weights (__b, __w): one row per group until the last step.

    The kernel at all distances between grid points is computed once per group; a
    point's density is the sum of the bins' weights times the kernel at their distance.
    """
    gstats = ["__n", "__from", "__delta", "__bw"]
    rows = bins.groupBy(*g, *gstats).agg(F.collect_list(F.struct(F.col("__b").alias("b"), F.col("__w").alias("w"))).alias("__bins"))
    points = F.sequence(F.lit(0), F.lit(n_grid - 1))
    step = F.col("__delta") / F.col("__bw")
    scale = F.lit(math.sqrt(2 * math.pi)) * F.col("__bw") * F.col("__n")
    kernel = F.transform(points, lambda d: F.exp(F.lit(-0.5) * d * step * d * step) / scale)

    def at_points(held: Column) -> Column:
        return F.transform(points, lambda i: F.aggregate(
            held["bins"], F.lit(0.0), lambda sum_, bin_: sum_ + bin_["w"] * F.get(held["kernel"], F.abs(i - bin_["b"]))))

    # Bound in an array, so that the kernel is not computed again for every point.
    bound = F.transform(F.array(F.struct(F.col("__bins").alias("bins"), kernel.alias("kernel"))), at_points)
    rows = rows.select(*g, *gstats, F.posexplode(F.get(bound, F.lit(0))).alias("__i", "density"))
    return rows.select(*g, F.col("__i").cast("long").alias("grid_index"),
                       (F.col("__from") + F.col("__i") * F.col("__delta")).alias("x"),
                       "density", F.col("__bw").alias("bw"), F.col("__n").alias("n"))


# --- regression / correlation ---------------------------------------------------

def lm_fit(df: DataFrame, x: str, y: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """Least-squares line of ``geom_smooth(method = "lm")``: slope, intercept, R²
    and the fitted end points over the x range.  Constant x → NULL fit."""
    xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
    agg = [
        F.count(F.when(xs.isNotNull() & ys.isNotNull(), F.lit(1))).alias("n"),
        F.regr_slope(ys, xs).alias("slope"),
        F.regr_intercept(ys, xs).alias("intercept"),
        F.regr_r2(ys, xs).alias("r2"),
        F.min(F.when(ys.isNotNull(), xs)).alias("x_min"),
        F.max(F.when(ys.isNotNull(), xs)).alias("x_max"),
    ]
    out = df.groupBy(*group_cols).agg(*agg) if group_cols else df.agg(*agg)
    return out.withColumn("y_at_x_min", F.col("intercept") + F.col("slope") * F.col("x_min")) \
              .withColumn("y_at_x_max", F.col("intercept") + F.col("slope") * F.col("x_max"))



def lm_fit_line(fit: DataFrame, group_cols: Sequence[str] = (), n_points: int = 80) -> DataFrame:
    """The fitted line as drawn by ``geom_smooth(method = "lm")``: ``n_points``
    evenly spaced x values over [x_min, x_max] with their fitted y.

    ``fit`` is the output of ``lm_fit`` (one row per group), so the result is
    ``n_points`` rows per group whatever the data size.  Groups whose fit is
    undefined (constant x) have no line.
    """
    g = list(group_cols)
    step = (F.col("x_max") - F.col("x_min")) / F.lit(n_points - 1)
    pts = fit.filter(F.col("slope").isNotNull()).select(
        *g, "slope", "intercept", "x_min", step.alias("__step"),
        F.explode(F.sequence(F.lit(0), F.lit(n_points - 1))).alias("point"))
    x = F.col("x_min") + F.col("point") * F.col("__step")
    return pts.select(*g, F.col("point").cast("long").alias("point"), x.alias("x"),
                      (F.col("intercept") + F.col("slope") * x).alias("fitted"))
