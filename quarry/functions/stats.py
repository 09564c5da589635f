"""Statistics as Column arithmetic; sequential ones as Arrow functions on sufficient statistics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

Z = 1.96


def wilson(k: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval of k in n, in percent; (0, 0) without rows."""
    p = k / n
    scale = 1 + z * z / n
    middle, half = (p + z * z / (2 * n)) / scale, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    return F.when(n > 0, 100 * (middle - half)).otherwise(0.0), F.when(n > 0, 100 * (middle + half)).otherwise(0.0)


def newcombe(k1: Column, n1: Column, k2: Column, n2: Column, z: float = Z) -> tuple[Column, Column, Column]:
    """Difference of two shares in percent points, with Newcombe's hybrid score bounds."""
    p1, p2 = 100 * k1 / n1, 100 * k2 / n2
    (l1, u1), (l2, u2) = wilson(k1, n1, z), wilson(k2, n2, z)
    d = p1 - p2
    return d, d - F.sqrt((p1 - l1) * (p1 - l1) + (u2 - p2) * (u2 - p2)), d + F.sqrt((u1 - p1) * (u1 - p1) + (p2 - l2) * (p2 - l2))


@F.pandas_udf(T.DoubleType())
def mcnemar_exact(b: pd.Series, c: pd.Series) -> pd.Series:
    """Two-sided exact binomial p of b against c discordant pairs; 1 without any."""

    def p(x: int, y: int) -> float:
        n, k = x + y, min(x, y)
        if n == 0:
            return 1.0
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(k + 1)]
        return min(1.0, 2 * math.fsum(map(math.exp, logs)))

    return pd.Series([p(int(x), int(y)) for x, y in zip(b, c, strict=True)])


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors over their common length; 0 for an empty or zero vector."""
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, 1, n), F.slice(b, 1, n)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    size = F.sqrt(total(F.transform(a, lambda x: x.cast("double") * x.cast("double")))) * F.sqrt(total(F.transform(b, lambda x: x.cast("double") * x.cast("double"))))
    return F.when((n > 0) & (size > 0), dot / size).otherwise(0.0)


def bounds(means: np.ndarray, alpha: float = 0.05) -> tuple[float, float]:
    """The order statistics at int(n alpha / 2) and int(n (1 - alpha / 2)) - 1, without interpolation."""
    low, high = int(len(means) * alpha / 2), max(0, int(len(means) * (1 - alpha / 2)) - 1)
    part = np.partition(means, (low, high))
    return float(part[low]), float(part[high])


def bootstrap_share(k: str, n: str, iterations: int = 1_000, seed: int = 0) -> Column:
    """low and high of a share of k among n, in percent: resampling rows of 0 and 1 is a binomial draw of their sum. Null without rows."""

    @F.pandas_udf("low double, high double")
    def run(k: pd.Series, n: pd.Series) -> pd.DataFrame:
        found = [bounds(100 * np.random.default_rng(seed).binomial(y, x / y, iterations) / y) if y else (None, None) for x, y in zip(k, n, strict=True)]
        return pd.DataFrame(found, columns=["low", "high"])

    return run(k, n)


def bootstrap_drop(k0: str, n0: str, k1: str, n1: str, iterations: int = 200_000, seed: int = 0) -> Column:
    """drop, low and high of the difference of two shares in percent points; the arms are drawn apart, with seed and seed + 1."""

    @F.pandas_udf("drop_pp double, low double, high double")
    def run(k0: pd.Series, n0: pd.Series, k1: pd.Series, n1: pd.Series) -> pd.DataFrame:
        draw = lambda k, n, s: 100 * np.random.default_rng(s).binomial(n, k / n, iterations) / n
        found = [(100 * (a / b - c / d), *bounds(draw(a, b, seed) - draw(c, d, seed + 1))) if b and d else (None,) * 3 for a, b, c, d in zip(k0, n0, k1, n1, strict=True)]
        return pd.DataFrame(found, columns=["drop_pp", "low", "high"])

    return run(k0, n0, k1, n1)


def _draws(values: np.ndarray, counts: np.ndarray, iterations: int, seed: int) -> np.ndarray:
    """Means of resamples of rows that are known by how often each value is there: draws of the counts are multinomial, in blocks of bounded size."""
    rng, n, out = np.random.default_rng(seed), int(counts.sum()), []
    step = max(1, 2_000_000 // len(values))
    for i in range(0, iterations, step):
        out.append(rng.multinomial(n, counts / n, min(step, iterations - i)) @ values / n)
    return np.concatenate(out)


def bootstrap_mean(arms: list[tuple[Column, Column]], key: Column, iterations: int, seed: int = 42) -> Column:
    """mean, low and high, in percent points, of the mean of rows by their values and counts (arrays of double and long), or of the difference of two such means.

    Rows may have any values, as accuracies in thirds; resampling them needs their histogram only. Groups draw apart, by seed and key (a long), and so do arms. Null where an arm
    has no rows.
    """

    n_arms = len(arms)

    @F.pandas_udf("mean double, low double, high double")
    def run(key: pd.Series, *cells: pd.Series) -> pd.DataFrame:
        found = []
        for k, *row in zip(key, *cells, strict=True):
            sides = [(np.asarray(v, np.float64), np.asarray(c, np.int64)) for v, c in zip(row[::2], row[1::2], strict=True) if v is not None and len(v)]
            if len(sides) < n_arms:
                found.append((None,) * 3)
                continue
            means = [100 * float(v @ c) / c.sum() for v, c in sides]
            draws = [100 * _draws(v, c, iterations, abs(hash((seed, int(k), i)))) for i, (v, c) in enumerate(sides)]
            drop = lambda x: x[0] - x[1] if len(x) == 2 else x[0]
            found.append((drop(means), *bounds(drop(draws))))
        return pd.DataFrame(found, columns=["mean", "low", "high"])

    return run(key, *[c for arm in arms for c in arm])


def histogram(value: str) -> tuple[Column, Column]:
    """Aggregates of the distinct values of a column of few values, and of their counts, from rows (value, n) that are counted already."""
    both = F.sort_array(F.collect_list(F.struct(F.col(value).alias("v"), "n")))
    return F.transform(both, lambda x: x["v"].cast("double")), F.transform(both, lambda x: x["n"].cast("long"))


def upper_median(values: Column) -> Column:
    """sorted[n // 2] of an array."""
    return F.element_at(F.sort_array(values), (F.size(values) / 2).cast("int") + 1)


#: Up to so many pairs the distribution of rank sums is counted out.
EXACT_PAIRS = 20


def signed_rank(n: Column, plus: Column, minus: Column) -> Column:
    """method, z, p: the two-sided signed-rank test of n pairs that differ, by the sums of ranks of those above and below.

    Up to EXACT_PAIRS pairs p counts the sign patterns with a sum as small as the lesser one: rank r adds to the number of patterns of each sum those of the sum
    less r. Beyond, z is normal. Without pairs p is 1.
    """
    small, least = n <= EXACT_PAIRS, F.least(plus, minus)
    zeros = lambda r: F.array_repeat(F.lit(0).cast("long"), r)
    ranks = F.filter(F.sequence(F.lit(1), F.lit(EXACT_PAIRS)), lambda r: r <= n)
    patterns = F.aggregate(ranks, F.array(F.lit(1).cast("long")), lambda d, r: F.zip_with(F.concat(d, zeros(r)), F.concat(zeros(r), d), lambda a, b: a + b))
    count = F.aggregate(F.slice(patterns, F.lit(1), (least + 1).cast("int")), F.lit(0).cast("long"), lambda a, x: a + x)
    exact = F.least(F.lit(1.0), 2 * count / F.pow(F.lit(2.0), n))
    z = (least - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24)

    @F.pandas_udf("double")
    def tails(z: pd.Series) -> pd.Series:
        from math import erfc

        return z.map(lambda x: erfc(abs(x) / 2**0.5), na_action="ignore")

    method = F.when(n == 0, "none").when(small, "exact").otherwise("normal")
    return F.struct(method.alias("method"), F.when(~small, z).alias("z"), F.when(n == 0, 1.0).when(small, exact).otherwise(tails(F.when(~small, z))).alias("p"))
