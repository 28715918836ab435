"""Gaussian mixtures of one column, for all series and all numbers of components at once.

Values are counted in bins first. An expectation-maximisation step is one grouped sum over (series, bins) and the parameters, which are
a row for each series and number of components: what a step reads does not grow with the rows, nor does one series pass
through one task for its size.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.ordered import matched
from ..plans.scratch import stored

LEAST = 1e-6  #: of a component's variance, as a share of all values'


def _densities(v: Column, parts: Column) -> Column:
    return F.transform(parts, lambda p: p["weight"] * F.exp(-0.5 * F.pow(v - p["mean"], F.lit(2)) / p["variance"]) / F.sqrt(2 * pi * p["variance"]))


def _total(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def fit(df: DataFrame, keys: list[str], col: str, ks: list[int], width: float, steps: int = 20) -> DataFrame:
    """(keys, k, n, parts, log_likelihood, aic, bic) of mixtures of ``ks`` components after ``steps`` steps.

    Values count as the middles of bins of ``width``; nulls are left out. parts: (weight, mean, variance), ordered by the mean. Components
    begin with equal weights, the variance of all values and means spread over three deviations. Series whose values lie in one bin have
    no row."""
    bins = df.where(F.col(col).isNotNull()).groupBy(*keys, ((F.floor(F.col(col) / width) + 0.5) * width).alias("_v")).agg(F.count("*").cast("double").alias("_c"))
    bins = stored(bins, "bins")
    whole = bins.groupBy(*keys).agg(F.sum("_c").alias("n"), (F.sum(F.col("_c") * F.col("_v")) / F.sum("_c")).alias("_mean"), F.sum(F.col("_c") * F.col("_v") * F.col("_v")).alias("_square"))
    whole = whole.withColumn("_all", F.col("_square") / F.col("n") - F.col("_mean") * F.col("_mean")).where("_all > 0").drop("_square")
    k = F.col("k")
    start = F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.struct((1.0 / k).alias("weight"), (F.col("_mean") + 1.5 * F.sqrt("_all") * (2 * (j + 0.5) / k - 1)).alias("mean"), F.col("_all").alias("variance")))
    now = stored(whole.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).withColumn("parts", start), "mixtures")
    by = [*keys, "k"]
    for step in range(steps + 1):
        d = matched(bins, now, keys).withColumn("_d", _densities(F.col("_v"), F.col("parts"))).withColumn("_t", F.greatest(_total(F.col("_d")), F.lit(1e-300)))
        if step == steps:
            break
        d = d.select(*by, "_v", "_c", F.posexplode(F.transform("_d", lambda x: x / F.col("_t"))).alias("j", "r"))
        sums = d.groupBy(*by, "j").agg(F.sum(F.col("_c") * F.col("r")).alias("s"), F.sum(F.col("_c") * F.col("r") * F.col("_v")).alias("sv"), F.sum(F.col("_c") * F.col("r") * F.col("_v") * F.col("_v")).alias("svv"))
        mean = F.col("sv") / F.greatest("s", F.lit(1e-300))
        sums = matched(sums, now.drop("parts"), by).withColumn("mean", mean)
        variance = F.greatest(F.col("svv") / F.greatest("s", F.lit(1e-300)) - F.col("mean") * F.col("mean"), LEAST * F.col("_all"))
        parts = F.array_sort(F.collect_list(F.struct("j", F.struct((F.col("s") / F.col("n")).alias("weight"), "mean", variance.alias("variance")).alias("p"))))
        now = stored(sums.groupBy(*by, "n", "_mean", "_all").agg(F.transform(parts, lambda x: x["p"]).alias("parts")), "mixtures")
    likely = d.groupBy(*by).agg(F.sum(F.col("_c") * F.log("_t")).alias("log_likelihood"))
    free = 3 * k - 1
    out = matched(now, likely, by).select(*by, "n", F.array_sort("parts", lambda a, b: F.signum(a["mean"] - b["mean"]).cast("int")).alias("parts"), "log_likelihood")
    return out.withColumns({"aic": 2 * free - 2 * F.col("log_likelihood"), "bic": free * F.log("n") - 2 * F.col("log_likelihood")})


def boundaries(mixtures: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, k, nth, boundary): where each component's weighted density meets the next one's, between their means; halfway where they
    don't meet there."""
    pairs = F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda j: F.struct(j.alias("nth"), F.element_at("parts", j).alias("a"), F.element_at("parts", j + 1).alias("b")))
    d = mixtures.where("k > 1").select(*keys, "k", F.explode(pairs).alias("p")).select(*keys, "k", "p.*")
    # log densities differ by q v^2 + l v + c
    q = 0.5 / F.col("b.variance") - 0.5 / F.col("a.variance")
    line = F.col("a.mean") / F.col("a.variance") - F.col("b.mean") / F.col("b.variance")
    c = F.log(F.col("a.weight") / F.col("b.weight")) + 0.5 * F.log(F.col("b.variance") / F.col("a.variance")) - 0.5 * F.col("a.mean") * F.col("a.mean") / F.col("a.variance") + 0.5 * F.col("b.mean") * F.col("b.mean") / F.col("b.variance")
    d = d.withColumns({"_q": q, "_l": line, "_c": c})
    root = F.sqrt(F.greatest(F.col("_l") * F.col("_l") - 4 * F.col("_q") * F.col("_c"), F.lit(0.0)))
    found = F.array(*((-F.col("_l") + s * root) / (2 * F.col("_q")) for s in (1, -1)))
    found = F.when(F.abs("_q") < 1e-12, F.array(F.try_divide(-F.col("_c"), F.col("_l")))).otherwise(found)
    within = F.filter(found, lambda v: (v >= F.col("a.mean")) & (v <= F.col("b.mean")))
    real = (F.col("_l") * F.col("_l") - 4 * F.col("_q") * F.col("_c") >= 0) & (F.size(within) > 0)
    return d.select(*keys, "k", "nth", F.when(real, F.get(within, 0)).otherwise((F.col("a.mean") + F.col("b.mean")) / 2).alias("boundary"))
