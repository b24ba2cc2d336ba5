"""Numbers over arrays and groups: the percentiles and spreads the measures use."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x.cast("double"))


def mean(xs: Column) -> Column:
    """Mean of an array; 0 of an empty one."""
    return F.when(F.size(xs) > 0, total(xs) / F.size(xs)).otherwise(0.0)


def deviation(xs: Column, ddof: int = 1) -> Column:
    """Standard deviation of an array; 0 for fewer than two values."""
    n, t = F.size(xs), total(xs)
    squares = F.aggregate(xs, F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    return F.when(n > 1, F.sqrt(F.greatest(squares - t * t / n, F.lit(0.0)) / (n - ddof))).otherwise(0.0)


def moments(xs: Column, finish: Callable[[Column, Column, Column], Column]) -> Column:
    """``finish`` of number, mean and sum of squared differences from it, in one pass that keeps equal values at a spread of
    exactly 0."""

    def step(a: Column, x: Column) -> Column:
        n = a["n"] + 1.0
        m = a["m"] + (x.cast("double") - a["m"]) / n
        return F.struct(n.alias("n"), m.alias("m"), (a["m2"] + (x.cast("double") - a["m"]) * (x.cast("double") - m)).alias("m2"))

    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("m2"))
    return F.aggregate(xs, zero, step, lambda a: finish(a["n"], a["m"], a["m2"]))


def linear(ordered: Column, q: float) -> Column:
    """Percentile of a sorted array by linear interpolation; 0 of an empty one."""
    at = F.lit(float(q)) * (F.size(ordered) - 1)
    i = F.floor(at).cast("int")
    lo = F.get(ordered, i).cast("double")
    hi = F.coalesce(F.get(ordered, i + 1).cast("double"), lo)
    return F.when(F.size(ordered) > 0, lo + (hi - lo) * (at - i)).otherwise(0.0)


def lower_rank(ordered: Column, q: float) -> Column:
    """The value at rank floor(q * (n - 1)) of a sorted array; null of an empty one."""
    return F.get(ordered, F.floor(F.lit(float(q)) * (F.size(ordered) - 1)).cast("int"))


def upper_middle(ordered: Column) -> Column:
    """The value at rank n // 2 of a sorted array; null of an empty one."""
    return F.get(ordered, F.floor(F.size(ordered) / 2).cast("int"))


def steps(xs: Column) -> Column:
    """Mean absolute difference of neighbours; 0 for fewer than two values."""
    d = F.zip_with(F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(0))), F.slice(xs, 1, F.greatest(F.size(xs) - 1, F.lit(0))), lambda a, b: F.abs(a - b))
    return F.when(F.size(xs) > 1, mean(d)).otherwise(0.0)


def length_stats(xs: Column, ordered: Column, prefix: str) -> dict[str, Column]:
    """Nine statistics of a list of lengths in its order; all 0 of an empty one."""
    m, sd = mean(xs), deviation(xs)
    return {
        f"{prefix}_mean": m,
        f"{prefix}_sd": sd,
        f"{prefix}_cv": F.when(m > 0, sd / m).otherwise(0.0),
        f"{prefix}_burstiness": F.when(sd + m > 0, (sd - m) / (sd + m)).otherwise(0.0),
        f"{prefix}_p10": linear(ordered, 0.10),
        f"{prefix}_p50": linear(ordered, 0.50),
        f"{prefix}_p90": linear(ordered, 0.90),
        f"{prefix}_iqr": linear(ordered, 0.75) - linear(ordered, 0.25),
        f"{prefix}_neighbour_delta": steps(xs),
    }


def rate(n: Column, words: Column) -> Column:
    """Per thousand words; 0 of no words."""
    return F.when(words > 0, F.lit(1000.0) * n / words).otherwise(0.0)


@F.pandas_udf(T.DoubleType())
def normal_tail(z: pd.Series) -> pd.Series:
    """Two-sided tail of the normal distribution beyond ``z``; neither Spark nor SQL has the error function."""
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2)) if v == v else None)


def mtld_of(tokens: list[str], threshold: float = 0.72) -> float:
    """Mean length of runs over which the share of new words stays above a threshold, read from both ends; 0 under 50
    words."""
    if len(tokens) < 50:
        return 0.0

    def one_way(seq) -> float:
        runs, seen, n = 0.0, set(), 0
        for t in seq:
            seen.add(t)
            n += 1
            if len(seen) <= threshold * n:
                runs, seen, n = runs + 1, set(), 0
        if n:
            runs += (1 - len(seen) / n) / (1 - threshold)
        return len(tokens) / runs if runs > 0 else float(len(tokens))

    return (one_way(tokens) + one_way(reversed(tokens))) / 2


@F.pandas_udf(T.DoubleType())
def _mtld(words: pd.Series) -> pd.Series:
    return words.map(lambda w: mtld_of(w.split(" ")) if w is not None else None)


def mtld(tokens: Column) -> Column:
    """The fold keeps a set as it goes, which no built-in expression does well: an Arrow function, to which the words of a
    document, none of which has a space, go as one string."""
    return _mtld(F.array_join(tokens, " "))
