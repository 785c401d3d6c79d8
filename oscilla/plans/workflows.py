"""Whole jobs as one plan each: dictionaries of a class, filters of a domain, evaluation over lengths.

Each is a chain of the library's operators; lengths, subjects and classes are columns, so a sweep is one
job and not a loop of jobs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..operators import evaluation, spectra, vectors, windows


def training_windows(series: DataFrame, *, label: int, cap: int, length: int, seed: int, taps: list[float] | None = None) -> DataFrame:
    """(id, v): tumbling windows of one class, of at most ``cap`` series a subject.

    ``series`` has subject, ic, label and samples. Subjects without the class drop out at the filter, and
    signals are filtered and cut only after the cap.
    """
    picked = windows.capped(series.where(F.col("label") == label), ["subject"], [F.xxhash64("ic", F.lit(seed)), F.col("ic")], cap)
    if taps is not None:
        picked = kernels.per_series(picked.select("subject", "ic", "samples"), lambda x: kernels.causal(x, taps)).withColumnRenamed("values", "samples")
    starts = F.sequence(F.lit(0), F.floor(F.size("samples") / length).cast("int") - 1)
    cut = picked.where(F.size("samples") >= length).select("subject", "ic", F.posexplode(F.transform(starts, lambda w: F.slice("samples", w * length + 1, F.lit(length)))).alias("win", "v"))
    return cut.select(F.xxhash64("subject", "ic", "win").alias("id"), "v")


def dictionary(series: DataFrame, *, label: int, k: int, centroid_length: int, window: int, cap: int = 10_000, seed: int = 13, **how) -> tuple[np.ndarray, DataFrame, float]:
    """Centroids, assignments and inertia of the shift-invariant dictionary of one class."""
    return vectors.shift_kmeans(training_windows(series, label=label, cap=cap, length=window, seed=seed), k, centroid_length, seed=seed, **how)


def domain_filters(sources: DataFrame, targets: DataFrame, method: str) -> DataFrame:
    """(subject, bin, h, method): filters that take each target subject's spectrum to the source domain."""
    wanted = spectra.channel_mean(targets)
    if method == "subj_to_subj":
        mean = spectra.channel_mean(sources)
        out = spectra.matched_filter(wanted, mean, spectra.nearest(wanted, mean))
    elif method in ("normed-barycenter", "original"):
        out = spectra.frequency_filter(spectra.unit_mass(wanted, ["subject"]), spectra.barycenter(sources, "normed"))
    elif method == "unnormed-barycenter":
        out = spectra.frequency_filter(wanted, spectra.barycenter(sources, "unnormed"))
    else:
        raise ValueError(f"no filter {method!r}")
    return out.withColumn("method", F.lit(method))


def dominant(codes: DataFrame, length: int) -> DataFrame:
    """(subject, seg, pred): the most frequent code of each whole segment, by pooled counts."""
    at = codes.withColumn("seg", F.floor(F.col("t") / length).cast("long"))
    whole = at.groupBy("subject", "seg").agg(F.count("*").alias("n")).where(F.col("n") == length).drop("n")
    return evaluation.majority(at.withColumnRenamed("code", "pred").join(whole, ["subject", "seg"], "left_semi"), ["subject", "seg"])


def pooled_predictions(codes: DataFrame, val: int) -> DataFrame:
    """(subject, group, pred) with features over whole validation segments."""
    return dominant(codes, val).withColumnRenamed("seg", "group")


def voted_predictions(codes: DataFrame, train: int, val: int) -> DataFrame:
    """(subject, group, pred) by votes of training segments within validation segments."""
    if evaluation.skip_short(train, val, True):
        raise ValueError("validation segments are shorter than training segments")
    return evaluation.regrouped_votes(dominant(codes, train), train, val)


def spectrum_frame(channels: DataFrame, *, srate: float, nperseg: int, average: str = "signals") -> DataFrame:
    """(subject, bin, db): the spectrum of each subject in decibels, from samples (subject, channel, t, x), to be plotted.

    ``signals`` averages the channels' samples and takes the spectrum of that, ``spectra`` averages the channels'
    spectra; the two differ wherever channels are not in phase.
    """
    if average not in ("signals", "spectra"):
        raise ValueError(f"no average {average!r}")
    by = ["subject"] if average == "signals" else ["subject", "channel"]
    rows = channels.groupBy("subject", "t").agg(F.avg("x").alias("x")) if average == "signals" else channels
    packed = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("t", "x"))).alias("s")).select(*by, F.transform("s", lambda s: s["x"]).alias("samples"))
    found = kernels.per_series(packed, kernels.welch_kernel(fs=srate, nperseg=nperseg)).select(*by, F.posexplode("values").alias("bin", "p"))
    mean = found if average == "signals" else spectra.channel_mean(found)
    return mean.select("subject", "bin", spectra.decibel(F.col("p")).alias("db"))
