"""Grouped least-squares polynomial."""

from __future__ import annotations

from functools import reduce
from math import comb

from pyspark.sql import Column, DataFrame, functions as F

from flightlens.functions.linalg import reduced, solve


def fit_polynomial(points: DataFrame, group: str, x: str, y: str, degree: int = 3) -> DataFrame:
    """Least squares of ``y`` on powers of ``x`` per group: ``group, c0..c<degree>, n``.

    Points are first summed per group and x, so that a group with very many points is spread over the
    cluster; power sums follow from that small table. They are taken of x moved and scaled to -1..1 per
    group, which keeps the system well conditioned wherever x lies, and the solution is expanded to plain
    powers. Groups with too few distinct x get null coefficients.
    """
    moments = _moments(points, group, x, y, degree)
    # row i of the system: power sums i to i + degree, then the right side
    rows = F.transform(
        F.sequence(F.lit(1), F.lit(degree + 1)),
        lambda i: F.concat(F.slice("_s", i, F.lit(degree + 1)), F.slice("_t", i, F.lit(1))),
    )
    fitted = moments.withColumn("_c", F.when(F.col("_distinct") > degree, solve(rows, degree + 1)))

    def plain(k: int) -> Column:
        """Coefficient of x**k."""
        return reduce(lambda a, b: a + b, [F.element_at("_c", j + 1) * share for j, share in _expansion(k, degree)])

    return fitted.select(group, *[plain(k).alias(f"c{k}") for k in range(degree + 1)], "n")


def _expansion(k: int, degree: int) -> list[tuple[int, Column]]:
    """What power j of the scaled x holds of ``x**k``: binomial(j, k) * (-middle)**(j - k) / half**j."""
    return [
        (j, F.lit(float(comb(j, k))) * F.pow(-F.col("_mid"), F.lit(j - k)) / F.pow("_half", F.lit(j)))
        for j in range(k, degree + 1)
    ]


def _moments(points: DataFrame, group: str, x: str, y: str, degree: int) -> DataFrame:
    """Per group the power sums of scaled x over n (``_s``), those times y (``_t``) and the centre and half width of x.

    For the fit's quality also the mean of y (``_mean``) and, of y less that mean, sums as in ``_t`` (``_tc``) and the mean
    square (``_vv``).
    """
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    cells = (
        points.select(group, px.alias("_x"), py.alias("_y"))
        .dropna(subset=["_x", "_y"])
        .groupBy(group, "_x")
        .agg(F.count(F.lit(1)).alias("_n"), F.sum("_y").alias("_sy"), F.sum(F.col("_y") * F.col("_y")).alias("_syy"))
    )
    ends = cells.groupBy(F.col(group).alias("_g")).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), (F.sum("_sy") / F.sum("_n")).alias("_mean"))
    middle, half = (F.col("_lo") + F.col("_hi")) / 2, (F.col("_hi") - F.col("_lo")) / 2
    ends = ends.select("_g", "_mean", middle.alias("_mid"), F.when(half > 0, half).alias("_half"))
    unit = (F.col("_x") - F.col("_mid")) / F.coalesce("_half", F.lit(1.0))
    cells = cells.join(ends, F.col(group).eqNullSafe(F.col("_g"))).withColumn("_x", unit)
    mean, n, sy = F.col("_mean"), F.col("_n"), F.col("_sy")
    powers = range(2 * degree + 1)
    sums = cells.groupBy(group, "_mid", "_half", "_mean").agg(
        F.count(F.lit(1)).alias("_distinct"),
        F.sum("_n").alias("n"),
        *[F.sum(F.col("_n") * F.pow("_x", F.lit(k))).alias(f"_s{k}") for k in powers],
        *[F.sum(sy * F.pow("_x", F.lit(k))).alias(f"_t{k}") for k in range(degree + 1)],
        *[F.sum((sy - n * mean) * F.pow("_x", F.lit(k))).alias(f"_tc{k}") for k in range(degree + 1)],
        F.sum(F.col("_syy") - 2 * mean * sy + n * mean * mean).alias("_vv"),
    )

    def scaled(name: str, count: int) -> Column:
        return F.transform(F.array(*[f"{name}{k}" for k in range(count)]), lambda v: v / F.col("n"))

    return sums.select(
        group, "_mid", "_half", "_mean", "_distinct", "n", (F.col("_vv") / F.col("n")).alias("_vv"),
        scaled("_s", len(powers)).alias("_s"), scaled("_t", degree + 1).alias("_t"), scaled("_tc", degree + 1).alias("_tc"),
    )


def fit_statistics(points: DataFrame, group: str, x: str, y: str, degree: int = 3) -> DataFrame:
    """How good :func:`fit_polynomial` is, per group, from the same sums; the model :func:`predict` takes.

    ``group, n, freedom, sigma, r2, adjusted_r2, se0..se<degree>`` and the columns that :func:`predict` reads. ``sigma`` is the
    root of the residual sum of squares over ``freedom`` = n - degree - 1, ``se<k>`` the standard error of ``c<k>``, from the
    inverse of the normal matrix. Null where freedom is 0 or x too poor; ``r2`` is null for constant y.
    """
    size = degree + 1
    moments = _moments(points, group, x, y, degree)
    unit = F.array(*[F.array(*[F.lit(1.0 if i == j else 0.0) for j in range(size)]) for i in range(size)])
    rows = F.transform(
        F.sequence(F.lit(1), F.lit(size)),
        lambda i: F.concat(F.slice("_s", i, F.lit(size)), F.slice("_tc", i, F.lit(1)), F.element_at(unit, i)),
    )
    solved = moments.withColumn("_e", F.when(F.col("_distinct") > degree, reduced(rows, size))).withColumns(
        {
            "_c": F.transform("_e", lambda r: F.element_at(r, size + 1)),
            "_inverse": F.transform("_e", lambda r: F.slice(r, size + 2, size)),
            "freedom": F.col("n") - size,
        }
    )
    explained = reduce(lambda a, b: a + b, [F.element_at("_c", k + 1) * F.element_at("_tc", k + 1) for k in range(size)])
    left = F.when(F.col("_c").isNotNull(), F.greatest(F.col("_vv") - explained, F.lit(0.0)) * F.col("n"))
    total = F.nullif(F.col("_vv") * F.col("n"), F.lit(0.0))
    solved = solved.withColumns({"_left": left, "_total": total}).withColumn("sigma", F.sqrt(F.col("_left") / F.when(F.col("freedom") > 0, F.col("freedom"))))

    def error(k: int) -> Column:
        shares = _expansion(k, degree)
        terms = [a * b * F.element_at(F.element_at("_inverse", i + 1), j + 1) for i, a in shares for j, b in shares]
        return F.col("sigma") * F.sqrt(F.greatest(reduce(lambda a, b: a + b, terms), F.lit(0.0)) / F.col("n"))

    spread = F.col("_left") / F.col("_total")
    return solved.select(
        group, "n", "freedom", "sigma", (1 - spread).alias("r2"),
        (1 - spread * (F.col("n") - 1) / F.when(F.col("freedom") > 0, F.col("freedom"))).alias("adjusted_r2"),
        *[error(k).alias(f"se{k}") for k in range(size)], "_mid", "_half", "_mean", "_c", "_inverse",
    )


def predict(at: DataFrame, model: DataFrame, group: str, x: str) -> DataFrame:
    """``at`` with ``fitted``, the standard error of that mean (``fit_error``) and of a single new value (``prediction_error``).

    ``model`` is what :func:`fit_statistics` gives, one row per group; rows of other groups get nulls.
    """
    side = model.select(F.col(group).alias("_g"), F.col("n").alias("_n"), F.col("sigma").alias("_sigma"), "_mid", "_half", "_mean", "_c", "_inverse")
    u = (F.col(x).cast("double") - F.col("_mid")) / F.col("_half")
    powers = F.transform(F.sequence(F.lit(0), F.size("_c") - 1), lambda k: F.pow(F.col("_u"), k))
    inner = lambda row: F.aggregate(F.zip_with(row, "_p", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    joined = at.join(side, F.col(group).eqNullSafe(F.col("_g")), "left").withColumn("_u", u).withColumn("_p", powers)
    reach = F.greatest(inner(F.transform("_inverse", inner)), F.lit(0.0)) / F.col("_n")
    return joined.withColumn("_reach", reach).select(
        *[F.col(f"`{c}`") for c in at.columns],
        (F.col("_mean") + inner(F.col("_c"))).alias("fitted"),
        (F.col("_sigma") * F.sqrt("_reach")).alias("fit_error"),
        (F.col("_sigma") * F.sqrt(1 + F.col("_reach"))).alias("prediction_error"),
    )
