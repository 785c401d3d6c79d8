"""Spectra in long form: barycenters, nearest distributions, filters, causal FIR, transforms by sums."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import settled


def channel_mean(spectra: DataFrame) -> DataFrame:
    """(subject, bin, p): mean over channels."""
    return spectra.groupBy("subject", "bin").agg(F.avg("p").alias("p"))


def unit_mass(spectra: DataFrame, group: list[str]) -> DataFrame:
    """``p`` divided by its sum over the group."""
    return spectra.withColumn("p", F.try_divide(F.col("p"), F.sum("p").over(Window.partitionBy(*group))))


def barycenter(spectra: DataFrame, kind: str = "normed") -> DataFrame:
    """(bin, p): the mean spectrum of the subjects.

    normed: channel means to unit mass first; unnormed: channel means as they are; joint: unit mass over
    all channels and bins of a subject, then the mean over channels; wasserstein: the squared mean of
    the roots of normed channel means.
    """
    if kind == "normed":
        return unit_mass(channel_mean(spectra), ["subject"]).groupBy("bin").agg(F.avg("p").alias("p"))
    if kind == "unnormed":
        return channel_mean(spectra).groupBy("bin").agg(F.avg("p").alias("p"))
    if kind == "joint":
        return channel_mean(unit_mass(spectra, ["subject"])).groupBy("bin").agg(F.avg("p").alias("p"))
    if kind == "wasserstein":
        return unit_mass(channel_mean(spectra), ["subject"]).groupBy("bin").agg(F.pow(F.avg(F.sqrt("p")), 2).alias("p"))
    raise ValueError(f"no barycenter {kind!r}")


def nearest(targets: DataFrame, sources: DataFrame, metric: str = "hellinger") -> DataFrame:
    """(target, source, dist): for each target subject the source whose spectrum is nearest, the least id on ties.

    hellinger compares spectra of unit mass, l2 the roots as they are, over the bins that both have. A spectrum is one
    row; the sources go to the tasks in ranges of about ``BLOCK_VALUES`` values, each with an index by pivots
    (``Cells``), and the best so far rides along, which lets later ranges be passed over.
    """
    if metric == "hellinger":
        targets, sources, scale = unit_mass(targets, ["subject"]), unit_mass(sources, ["subject"]), 0.5
    elif metric == "l2":
        scale = 1.0
    else:
        raise ValueError(f"no metric {metric!r}")
    bins, subjects = sources.agg(F.max("bin"), F.countDistinct("subject")).first()
    width = 0 if bins is None else int(bins) + 1
    ranges = 1 + subjects * width // BLOCK_VALUES

    def arrays(rows: DataFrame, name: str) -> DataFrame:
        """One row a subject: roots by bin, null where there is none; bins beyond those of the sources meet nothing."""
        table = rows.where((F.col("bin") >= 0) & (F.col("bin") < width)).groupBy(F.col("subject").alias(name)).agg(F.map_from_entries(F.collect_list(F.struct("bin", F.sqrt("p").alias("r")))).alias("m"))
        return table.select(name, F.transform(F.sequence(F.lit(0), F.lit(max(width - 1, 0))), lambda i: F.try_element_at("m", i.cast(rows.schema["bin"].dataType))).alias("r"))

    places = arrays(sources, "source").repartitionByRange(ranges, "source").withColumn("block", F.spark_partition_id())
    places = settled(places, "spectra")
    kinds = targets.schema["subject"].dataType.simpleString(), sources.schema["subject"].dataType.simpleString()
    schema = f"target {kinds[0]}, r array<double>, source {kinds[1]}, dist double"
    state = arrays(targets, "target").withColumns({"source": F.lit(None).cast(kinds[1]), "dist": F.lit(None).cast("double")})
    for block in range(ranges):
        rows = places.where(F.col("block") == block).orderBy("source").collect()  # about BLOCK_VALUES values
        there = np.array([[np.nan if x is None else x for x in r.r] for r in rows], np.float64).reshape(len(rows), max(width, 1))
        shared = places.sparkSession.sparkContext.broadcast(([r.source for r in rows], Cells(there, scale)))
        state = (settled(state, "nearest") if block else state).mapInPandas(_nearer(shared), schema)
    return state.where("source is not null").select("target", "source", "dist")


#: Values of source spectra that are sent to every task at once.
BLOCK_VALUES = 2_000_000


class Cells:
    """Spectra dealt to the nearest of about the root of their number of pivots, for searches by the triangle inequality.

    A cell is passed over if its pivot is farther away than its radius and the best distance so far. Spectra that lack a
    bin are compared over the bins that both have, which is no metric, so they are met by all.
    """

    def __init__(self, there: np.ndarray, scale: float) -> None:
        self.there, self.scale = there, scale
        missing = np.isnan(there).any(1)
        self.rest, rows = np.flatnonzero(missing), np.flatnonzero(~missing)
        size = int(np.ceil(np.sqrt(len(rows))))
        self.pivots = there[rows[:: max(1, size)]] if len(rows) else there[:0]
        cell, gap = np.zeros(len(rows), np.int64), np.zeros(len(rows))
        for low in range(0, len(rows), 1024):
            to = self._gaps(there[rows[low : low + 1024], None], self.pivots[None])
            cell[low : low + 1024], gap[low : low + 1024] = to.argmin(1), to.min(1)
        order = np.argsort(cell, kind="stable")
        self.rows = rows[order]
        self.bounds = np.searchsorted(cell[order], np.arange(len(self.pivots) + 1))
        self.radius = np.array([gap[order[i:j]].max(initial=0.0) for i, j in zip(self.bounds, self.bounds[1:])])
        self.computed = 0

    def _gaps(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        gaps = (a - b) ** 2
        met = ~np.isnan(gaps)
        return np.where(met.any(-1), np.sqrt(np.where(met, gaps, 0.0).sum(-1) * self.scale), np.inf)

    def nearest(self, own: np.ndarray, best: float = np.inf) -> tuple[int, float] | None:
        """The place and distance, to nine digits, of the spectrum nearest to ``own`` and nearer than ``best``; the first of equal ones."""
        found: tuple[float, int] = (best, -1)

        def meet(rows: np.ndarray) -> None:
            nonlocal found
            if not len(rows):
                return
            self.computed += len(rows)
            dist = np.round(self._gaps(self.there[rows], own), 9)
            least = dist.min()
            if np.isfinite(least) and least < best:
                found = min(found, (float(least), int(rows[dist == least].min())))

        meet(self.rest)
        if np.isnan(own).any():
            meet(self.rows)
        elif len(self.pivots):
            self.computed += len(self.pivots)
            least = self._gaps(self.pivots, own) - self.radius
            for cell in np.argsort(least, kind="stable"):
                if least[cell] > found[0] + 1e-8:  # more than rounding can hide
                    break
                meet(self.rows[self.bounds[cell] : self.bounds[cell + 1]])
        return (found[1], found[0]) if found[1] >= 0 else None


def _nearer(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, cells = shared.value
        for batch in batches:
            batch = batch.copy()
            for row in batch.index if len(names) else ():
                own = np.array([np.nan if x is None else x for x in batch.at[row, "r"]], np.float64)
                old = batch.at[row, "dist"]
                found = cells.nearest(own, np.inf if pd.isna(old) else old)
                if found is not None:
                    batch.at[row, "source"], batch.at[row, "dist"] = names[found[0]], found[1]
            yield batch

    return run


def frequency_filter(target: DataFrame, wanted: DataFrame) -> DataFrame:
    """(subject, bin, h): root of the wanted spectrum over that of the subject; 0 where the subject has nothing."""
    both = target.join(wanted.select("bin", F.col("p").alias("q")), "bin")
    return both.select("subject", "bin", F.coalesce(F.try_divide(F.sqrt("q"), F.sqrt("p")), F.lit(0.0)).alias("h"))


def matched_filter(targets: DataFrame, sources: DataFrame, matches: DataFrame) -> DataFrame:
    """(subject, bin, h): root of the matched source's channel mean over that of the target."""
    picked = matches.select(F.col("target").alias("subject"), "source")
    wanted = sources.select(F.col("subject").alias("source"), "bin", F.col("p").alias("q"))
    both = targets.join(picked, "subject").join(wanted, ["source", "bin"])
    return both.select("subject", "bin", F.coalesce(F.try_divide(F.sqrt("q"), F.sqrt("p")), F.lit(0.0)).alias("h"))


def taps(filters: DataFrame, m: int) -> DataFrame:
    """(subject, k, h): real impulse responses of 2 (m - 1) taps from ``m`` real frequency values, by cosine sums."""
    n = 2 * (m - 1)
    weight = F.when((F.col("bin") == 0) | (F.col("bin") == m - 1), 1.0).otherwise(2.0)
    spread = filters.select("subject", "bin", "h", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
    angle = 2 * math.pi / n * F.pmod(F.col("bin") * F.col("k"), F.lit(n))
    return spread.groupBy("subject", "k").agg((F.sum(weight * F.col("h") * F.cos(angle)) / n).alias("h"))


#: Samples of a chunk of a series that is filtered at once; more if the taps reach further.
CHUNK = 1 << 14


def causal_fir(samples: DataFrame, filters: DataFrame, *, chunk: int | None = None) -> DataFrame:
    """(subject, t, y): y_t = sum over k of h_k x_(t-k), each subject by its own taps; a sample that no tap of any sample reaches has no result.

    Overlap-save: a series is cut into chunks at least as long as the taps reach, and the end of each goes to the next one,
    too. A chunk is filtered by one product of transforms, so the work a sample grows with the logarithm of the number of
    taps, and a series of any length is no single task.
    """
    reach = filters.where("k >= 0").agg(F.max("k")).first()[0]
    if reach is None:
        return samples.select("subject", "t", F.lit(0.0).alias("y")).limit(0)
    reach = int(reach)
    size = max(chunk or CHUNK, reach + 1)
    taps = filters.where("k >= 0").select("subject", F.struct(F.col("k").cast("long").alias("k"), F.col("h").cast("double").alias("h")).alias("s"))
    taps = taps.groupBy("subject").agg(F.collect_list("s").alias("taps"))
    own = F.floor(F.col("t") / size).cast("long")
    late = F.pmod(F.col("t"), F.lit(size)) >= size - reach
    spread = samples.select("subject", "t", F.col("x").cast("double").alias("x"), F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own))).alias("chunk"))
    chunks = spread.groupBy("subject", "chunk").agg(F.collect_list(F.struct(F.col("t").cast("long").alias("t"), "x")).alias("s")).join(taps, "subject")
    kind = samples.schema["subject"].dataType.simpleString()
    # a field of an array of structs is the array of that field
    flat = chunks.select("subject", "chunk", "s.t", "s.x", "taps.k", "taps.h")
    done = flat.mapInPandas(_filtered(size, reach), f"subject {kind}, t array<long>, y array<double>")
    return done.select("subject", F.explode(F.arrays_zip("t", "y")).alias("r")).select("subject", F.col("r.t").cast(samples.schema["t"].dataType).alias("t"), "r.y")


def _filtered(size: int, reach: int):
    """Chunks of samples (t, x) with the ``reach`` before them, and taps (k, h), to the chunks' own samples filtered."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[list] = [[], []]
            for number, t, x, k, h in zip(batch["chunk"], batch["t"], batch["x"], batch["k"], batch["h"]):
                first = number * size - reach
                at = np.asarray(t, np.int64) - first
                values, there, own = np.zeros(size + reach), np.zeros(size + reach), np.zeros(reach + 1)
                np.add.at(values, at, np.asarray(x, np.float64))
                there[at] = 1
                own[np.asarray(k, np.int64)] = np.asarray(h, np.float64)
                tapped = np.zeros(reach + 1)
                tapped[np.asarray(k, np.int64)] = 1
                wanted = np.unique(at[at >= reach])
                # whether a tap meets a sample is counted, too; both counts are whole numbers
                met = _convolved(there, tapped)[wanted] > 0.5
                kept = wanted[met]
                out[0].append(kept + first)
                out[1].append(_convolved(values, own)[kept])
            yield pd.DataFrame({"subject": batch["subject"], "t": out[0], "y": out[1]})

    return run


def _convolved(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The first len(x) values of the convolution, by a product of transforms unless there are few taps."""
    if len(h) <= 32:
        return np.convolve(x, h)[: len(x)]
    n = 1 << (len(x) + len(h) - 2).bit_length()
    return np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(h, n), n)[: len(x)]


def channel_gain(samples: DataFrame, gains: DataFrame) -> DataFrame:
    """(subject, channel, t, y): each channel times its own value of the filter."""
    return samples.join(gains, ["subject", "channel"]).select("subject", "channel", "t", (F.col("x") * F.col("h")).alias("y"))


def periodogram(samples: DataFrame, length: int, bins: int) -> DataFrame:
    """(subject, win, bin, power): squared magnitude of the discrete Fourier transform of each full window, by sums.

    A window is one array before its bins are made, so a sample is shuffled once.
    """
    win = F.floor(F.col("t") / length).cast("long")
    packed = samples.groupBy("subject", win.alias("win")).agg(F.collect_list(F.struct(F.pmod("t", F.lit(length)).alias("j"), "x")).alias("s")).where(F.size("s") == length)

    def part(bin_: Column, wave) -> Column:
        return F.aggregate("s", F.lit(0.0), lambda a, p: a + p["x"] * wave(2 * math.pi / length * F.pmod(bin_ * p["j"], F.lit(length))))

    powers = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.pow(part(b, F.cos), 2) + F.pow(part(b, F.sin), 2))
    return packed.select("subject", "win", F.posexplode(powers).alias("bin", "power"))


def autocorrelation(samples: DataFrame, lags: int, *, chunk: int | None = None) -> DataFrame:
    """(subject, lag, r): sums of products of samples ``lag`` apart, over that of lag 0; null where none are.

    A series is cut into chunks, each with the first ``lags`` samples of the next one. A chunk's sums by lag are one vector,
    and vectors add up, so a series of any length is no single task and no sample is multiplied by lags in a shuffle.
    """
    size = max(chunk or CHUNK, lags + 1)
    own = F.floor(F.col("t") / size).cast("long")
    early = (F.pmod(F.col("t"), F.lit(size)) < lags) & (own > 0)
    spread = samples.select("subject", "t", F.col("x").cast("double").alias("x"), F.explode(F.when(early, F.array(own, own - 1)).otherwise(F.array(own))).alias("chunk"))
    chunks = spread.where("x is not null").groupBy("subject", "chunk").agg(F.collect_list(F.struct((F.col("t") - F.col("chunk") * size).cast("long").alias("t"), "x")).alias("s"))
    kind = samples.schema["subject"].dataType.simpleString()
    sums = chunks.select("subject", "s.t", "s.x").mapInPandas(_lag_products(size, lags), f"subject {kind}, lag int, s double")
    sums = sums.groupBy("subject", "lag").agg(F.sum("s").alias("s"))
    zero = F.max(F.when(F.col("lag") == 0, F.col("s"))).over(Window.partitionBy("subject"))
    return sums.select("subject", "lag", F.try_divide("s", zero).alias("r"))


def _lag_products(size: int, lags: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for subject, t, x in zip(batch["subject"], batch["t"], batch["x"]):
                values, there = np.zeros(size + lags), np.zeros(size + lags)
                at = np.asarray(t, np.int64)
                values[at], there[at] = np.asarray(x, np.float64), 1
                # a chunk's own samples against all that lie up to ``lags`` behind them
                sums, pairs = (_correlated(y[:size], y, lags) for y in (values, there))
                yield pd.DataFrame({"subject": subject, "lag": np.arange(lags + 1, dtype=np.int32), "s": [float(s) if n > 0.5 else None for s, n in zip(sums, pairs)]})

    return run


def _correlated(a: np.ndarray, b: np.ndarray, lags: int) -> np.ndarray:
    """Sums of a_i b_(i + k) for k up to ``lags``; ``b`` is that much longer than ``a``."""
    if lags <= 32:
        return np.array([a @ b[k : k + len(a)] for k in range(lags + 1)])
    n = 1 << (len(b) - 1).bit_length() + 1
    return np.fft.irfft(np.conj(np.fft.rfft(a, n)) * np.fft.rfft(b, n), n)[: lags + 1]


def min_max(rows: DataFrame, group: list[str], value: str, low: float = -1.0, high: float = 1.0) -> Column:
    """``value`` scaled so that its group spans ``low`` to ``high``; a constant group is the middle."""
    by = Window.partitionBy(*group)
    lo, hi = F.min(value).over(by), F.max(value).over(by)
    return F.coalesce(F.try_divide(F.col(value) - lo, hi - lo), F.lit(0.5)) * (high - low) + low


def notch_undo(spectra: DataFrame, bins: list[int], gap_db: float = 5.0) -> DataFrame:
    """Decibel spectra with each listed bin, in order, set to its neighbours' mean if both exceed it by more than ``gap_db``."""
    by = Window.partitionBy("subject").orderBy("bin")
    for b in bins:
        before, after = F.lag("p").over(by), F.lead("p").over(by)
        dip = (F.col("bin") == b) & (before - F.col("p") > gap_db) & (after - F.col("p") > gap_db)
        spectra = spectra.withColumn("p", F.when(dip, (before + after) / 2).otherwise(F.col("p")))
    return spectra


def decibel(p: Column, factor: float = 10.0) -> Column:
    """``factor`` times log10, null for what is not above 0."""
    return factor * F.log10(F.when(p > 0, p))


def unmixed(weights: DataFrame, samples: DataFrame) -> DataFrame:
    """(ic, t, x): the matrix product of weights (ic, channel, w) and samples (channel, t, x).

    Up to ``BLOCK_VALUES`` weights are sent to every task, so samples are summed where they are read; more are joined.
    """
    weights = F.broadcast(weights) if weights.count() <= BLOCK_VALUES else weights
    return weights.join(samples, "channel").groupBy("ic", "t").agg(F.sum(F.col("w") * F.col("x")).alias("x"))


def matrix_product(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, v): the product of matrices (i, k, v) and (k, j, v)."""
    left, right = a.select("i", "k", F.col("v").alias("l")), b.select("k", "j", F.col("v").alias("r"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("l") * F.col("r")).alias("v"))
