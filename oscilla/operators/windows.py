"""Windows and segments by sample index: tumbling, sliding, overlapping, prefixes; capped samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tumbling(samples: DataFrame, length: int) -> DataFrame:
    """(subject, win, n, sum_x, min_x, max_x) of the full windows of ``length`` samples; the ragged tail is dropped."""
    win = F.floor(F.col("t") / length).cast("long")
    out = samples.groupBy("subject", win.alias("win")).agg(F.count("*").alias("n"), F.sum("x").alias("sum_x"), F.min("x").alias("min_x"), F.max("x").alias("max_x"))
    return out.where(F.col("n") == length)


#: Samples of a piece of a long series; a series is no single task.
CHUNK = 1 << 16


def sliding(samples: DataFrame, length: int, chunk: int | None = None) -> DataFrame:
    """(subject, start, sum_x) for the windows of ``length`` samples from every sample on.

    A series is cut into pieces of ``chunk`` samples, the first samples of each going to the piece before, too.
    """
    size = max(chunk or CHUNK, length)
    own = F.floor(F.col("t") / size).cast("long")
    spread = samples.withColumn("own", own).withColumn("piece", F.explode(F.when((F.col("own") > 0) & (F.col("t") % size < length - 1), F.array(F.col("own"), F.col("own") - 1)).otherwise(F.array("own"))))
    ahead = Window.partitionBy("subject", "piece").orderBy("t").rowsBetween(0, length - 1)
    sums = spread.select("subject", F.col("t").alias("start"), "own", "piece", F.sum("x").over(ahead).alias("sum_x"), F.count("*").over(ahead).alias("n"))
    return sums.where((F.col("n") == length) & (F.col("own") == F.col("piece"))).select("subject", "start", "sum_x")


def sliding_arrays(series: DataFrame, length: int, offsets: list[int] | None = None) -> DataFrame:
    """(subject, start, w) from packed series: the windows at every offset or at the given ones that fit."""
    last = F.size("samples") - length
    starts = F.array(*map(F.lit, offsets)) if offsets is not None else F.when(last >= 0, F.sequence(F.lit(0), last))
    out = series.select("subject", "samples", F.explode(starts).alias("start")).where((F.col("start") >= 0) & (F.col("start") <= F.size("samples") - length))
    return out.select("subject", "start", F.slice("samples", F.col("start") + 1, F.lit(length)).alias("w"))


def distinct_offsets(count: Column, n: int, key: Column, seed: int) -> Column:
    """``n`` distinct numbers below ``count`` (all of them, if there are fewer), drawn evenly by hashes of key, draw and seed.

    Draw i is a number up to j = count - n + i; one that is there already becomes j, which can't be (Floyd's
    sampling). So n draws cost n steps, however large ``count`` is.
    """
    size = F.least(F.lit(n).cast("long"), count.cast("long"))
    none = F.expr("cast(array() as array<bigint>)")

    def draw(drawn: Column, i: Column) -> Column:
        last = count - size + i
        hashed = F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), i.cast("string"), F.lit(str(seed))).cast("binary")), 1, 15), 16, 10).cast("long")
        at = hashed % (last + 1)
        return F.concat(drawn, F.array(F.when(F.array_contains(drawn, at), last).otherwise(at)))

    return F.when(size > 0, F.aggregate(F.sequence(F.lit(0).cast("long"), size - 1), none, draw)).otherwise(none)


def random_offsets(series: DataFrame, length: int, n_windows: int, seed: int) -> DataFrame:
    """(subject, start, w): ``n_windows`` distinct windows of each series; only those that are drawn are made."""
    starts = distinct_offsets(F.greatest(F.size("samples") - length + 1, F.lit(0)), n_windows, F.col("subject"), seed)
    out = series.select("subject", "samples", F.explode(starts).alias("start"))
    return out.select("subject", F.col("start").cast("int").alias("start"), F.slice("samples", (F.col("start") + 1).cast("int"), F.lit(length)).alias("w"))


def half_overlapping(samples: DataFrame, length: int) -> DataFrame:
    """(subject, seg, sum_x): segments of ``length`` samples, each half a segment after the last.

    A series of N samples has 2 * floor(N / length) - 1 of them. Each sample goes to the two segments
    that can hold it, so nothing is joined.
    """
    half = length // 2
    total = Window.partitionBy("subject")
    first = F.floor(F.col("t") / half).cast("long")
    spread = samples.withColumn("n", F.count("*").over(total)).select("subject", "x", "n", F.explode(F.array(first - 1, first)).alias("seg"))
    kept = spread.where((F.col("seg") >= 0) & (F.col("seg") < 2 * F.floor(F.col("n") / length) - 1))
    return kept.groupBy("subject", "seg").agg(F.sum("x").alias("sum_x"))


def prefixes(samples: DataFrame, lengths: list[int]) -> DataFrame:
    """(length, subject, n, sum_x): aggregates of the first samples, for several prefix lengths in one pass."""
    spread = samples.select("subject", "t", "x", F.explode(F.array(*map(F.lit, lengths))).alias("length")).where(F.col("t") < F.col("length"))
    return spread.groupBy("length", "subject").agg(F.count("*").alias("n"), F.sum("x").alias("sum_x"))


def segments(samples: DataFrame, length: int | None) -> Column:
    """The segment of a sample; one segment if ``length`` is None."""
    return F.lit(0).cast("long") if length is None else F.floor(F.col("t") / length).cast("long")


def window_count(n_points: Column, srate: float, seconds: float) -> Column:
    """Windows needed for so many points; fails where a window has no sample."""
    if int(seconds * srate) < 1:
        raise ValueError("a window must have a sample")
    return F.ceil(n_points / (seconds * srate)).cast("long")


def capped(rows: DataFrame, group: list[str], order: list[Column], cap: int) -> DataFrame:
    """At most ``cap`` rows of each group, the first by ``order``; groups up to the cap stay whole."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_rank") <= cap).drop("_rank")


def seconds_to_units(seconds: float | list[float], *, per_second: float) -> int | None | list[int | None]:
    """Durations to windows or samples: -1 means the whole series; below one unit a second they must divide evenly."""
    if isinstance(seconds, list):
        return [seconds_to_units(s, per_second=per_second) for s in seconds]
    if isinstance(seconds, bool) or not isinstance(seconds, (int, float)):
        raise TypeError("a duration or a list of durations is needed")
    if seconds == -1:
        return None
    units = seconds * per_second
    if per_second < 1 and abs(units - round(units)) > 1e-9:
        raise ValueError(f"{seconds} s is no whole number of windows of {1 / per_second:g} s")
    return int(round(units) if per_second < 1 else units)
