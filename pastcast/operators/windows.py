"""Windows of series as arrays: cutting, normalising, resampling, embedding, describing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pastcast.functions.common import pair_sum, total
from pastcast.sources.series import chunked

CHUNK = 4096


def chunk_arrays(rows: DataFrame, width: int, size: int = CHUNK, stride: int = 1) -> DataFrame:
    """(series_id, chunk, first, values): stretches of at most ``size`` window starts, with the width - 1 values that follow.

    The stretch is a multiple of the stride, so the result does not depend on it.
    """
    size = max(size // stride, 1) * stride
    if size < width:
        size = -(-width // stride) * stride
    parts = chunked(rows.select("series_id", "pos", "value"), after=width - 1, size=size)
    made = parts.groupBy("series_id", "chunk").agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("s"))  # at most size + width rows
    return made.select("series_id", "chunk", (F.col("chunk") * size).alias("first"), F.col("s.value").alias("values"), F.lit(size).alias("size"))


def windows(rows: DataFrame, width: int, stride: int = 1, size: int = CHUNK) -> DataFrame:
    """(series_id, start, values) of every window [start, start + width) at multiples of the stride."""
    c = chunk_arrays(rows, width, size, stride)
    last = F.least(F.col("size") - 1, F.size("values") - width)
    at = F.explode(F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(stride))).otherwise(F.array().cast("array<int>"))).alias("at")
    return c.select("series_id", "first", "values", at).select("series_id", (F.col("first") + F.col("at")).alias("start"), F.slice("values", F.col("at") + 1, width).alias("values"))


def half_even(x: float) -> int:
    return round(x)


def scaled_widths(base: int, scales: tuple[float, ...] = (0.5, 0.75, 1.0, 1.5, 2.0)) -> list[int]:
    """Window widths of a multi-scale search, at least 2, halves to even."""
    return [max(2, half_even(base * s)) for s in scales]


def multi_scale(rows: DataFrame, base: int, stride: int = 1, scales: tuple[float, ...] = (0.5, 0.75, 1.0, 1.5, 2.0)) -> DataFrame:
    """Windows of every scale, with their width; a series shorter than a width has none of it."""
    out = None
    for w in dict.fromkeys(scaled_widths(base, scales)):
        some = windows(rows, w, stride).withColumn("width", F.lit(w))
        out = some if out is None else out.unionByName(some)
    return out


def mean(v: Column) -> Column:
    return total(v) / F.size(v)


def deviation(v: Column) -> Column:
    """Population standard deviation of an array."""
    return F.sqrt(total(F.zip_with(v, F.array_repeat(mean(v), F.size(v)), lambda x, m: (x - m) * (x - m))) / F.size(v))


def running_deviation(v: Column) -> Column:
    """The population standard deviation, value by value (Welford): exactly 0 where all are equal, and the last digit is that of SQL."""

    def step(a: Column, x: Column) -> Column:
        mean = a["m"] + (x - a["m"]) / (a["n"] + 1)
        return F.struct((a["n"] + 1).alias("n"), mean.alias("m"), (a["s"] + (x - mean) * (x - a["m"])).alias("s"))

    return F.aggregate(v, F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("s")), step, lambda a: F.sqrt(F.try_divide(a["s"], a["n"])))


def scaled(v: Column, low: Column, span: Column) -> Column:
    """(x - low) / span, zeros where the span is 0."""
    by = F.array_repeat(F.struct(low.alias("low"), span.alias("span")), F.size(v))  # an argument is evaluated once, a lambda's body for each element
    return F.zip_with(v, by, lambda x, c: F.when(c.span == 0, 0.0).otherwise((x - c.low) / c.span))


def log_returns(v: Column, floor: float = 1e-12) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(v) - 1), lambda i: F.log(F.greatest(F.get(v, i), F.lit(floor))) - F.log(F.greatest(F.get(v, i - 1), F.lit(floor))))


def normalised(df: DataFrame, method: str, values: str = "values", out: str = "normal") -> DataFrame:
    """Adds the normalised array: raw, zscore, minmax, logreturn or logreturn_zscore; flat windows become zeros."""
    v = F.col(values)
    if method.startswith("logreturn"):
        df, v = df.withColumn("_r", log_returns(v)), F.col("_r")
    if method in ("raw", "logreturn"):
        return df.withColumn(out, v).drop("_r")
    if method in ("zscore", "logreturn_zscore"):
        return df.withColumns({"_m": mean(v), "_s": running_deviation(v)}).withColumn(out, scaled(v, F.col("_m"), F.col("_s"))).drop("_m", "_s", "_r")
    if method == "minmax":
        return df.withColumn(out, scaled(v, F.array_min(v), F.array_max(v) - F.array_min(v)))
    raise ValueError(f"not a normalisation: {method!r}")


def resampled(v: Column, n: int) -> Column:
    """Linear resample of an array to n values."""
    last = F.size(v) - 1
    if n == 1:
        return F.array(F.get(v, last))

    def at(j: Column) -> Column:
        x = j * last / float(n - 1)
        k = F.least(F.floor(x).cast("int"), last)
        a, b = F.get(v, k), F.get(v, F.least(k + 1, last))
        return a + (x - k) * (b - a)

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at)


def embedded(v: Column, dims: int, lag: int) -> Column:
    """Delay rows, the newest value first."""
    return F.transform(F.sequence(F.lit((dims - 1) * lag), F.size(v) - 1), lambda i: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda k: F.get(v, i - k * lag)))


def slope(v: Column) -> Column:
    """Least-squares slope against 0, 1, 2, ..."""
    n = F.size(v).cast("double")
    sx, sxx = n * (n - 1) / 2, n * (n - 1) * (2 * n - 1) / 6
    sxy = pair_sum(v, F.transform(F.sequence(F.lit(0), F.size(v) - 1), lambda i: i.cast("double")))
    return (n * sxy - sx * total(v)) / (n * sxx - sx * sx)


def descriptor(df: DataFrame, values: str = "values") -> DataFrame:
    """Adds mean, sd, slope, peak, zc, ac, hurst and range of a window of more than 30 values."""
    v, n = F.col(values), F.size(values)
    span = lambda a, b: F.sequence(F.lit(a) if isinstance(a, int) else a, b)
    df = df.withColumns({"mean": mean(v), "sd": deviation(v), "slope": slope(v), "peak": (F.array_position(v, F.array_max(v)) - 1) / n, "range": F.array_max(v) - F.array_min(v)})
    up = F.transform(span(1, n - 1), lambda i: F.get(v, i) - F.get(v, i - 1) >= 0)
    df = df.withColumn("_up", up)
    turns = F.size(F.filter(span(1, n - 2), lambda i: F.get(F.col("_up"), i) != F.get(F.col("_up"), i - 1)))
    lagged = lambda k: total(F.transform(span(k, n - 1), lambda i: (F.get(v, i) - F.get(v, i - k)) * (F.get(v, i) - F.get(v, i - k))))
    ac = total(F.transform(span(10, n - 1), lambda i: (F.get(v, i) - F.col("mean")) * (F.get(v, i - 10) - F.col("mean")))) / (n - 10)
    ratio = 0.5 * F.log((lagged(30) + 1e-6) / (lagged(5) + 1e-6)) / math.log(6)
    return df.withColumns({"zc": turns / n, "ac": ac, "hurst": F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio))}).drop("_up")


def descriptor_distance(a: str, b: str) -> Column:
    """Weighted distance of two descriptors, structs a and b."""
    weight = {"slope": 2.0, "peak": 1.0, "zc": 1.0, "hurst": 1.5, "sd": 0.8, "ac": 0.02}
    return F.sqrt(sum((((F.col(f"{a}.{k}") - F.col(f"{b}.{k}")) * w) ** 2 for k, w in weight.items()), F.lit(0.0)))


def descriptor_label(hurst: Column) -> Column:
    return F.when(hurst > 0.58, "Trending").when(hurst < 0.42, "Mean-rev").otherwise("Random")
