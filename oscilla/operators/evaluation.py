"""Votes, ensembles and scores; reports over result rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def majority(predictions: DataFrame, keys: list[str], value: str = "pred") -> DataFrame:
    """The most frequent prediction of each group, the smallest of equally frequent ones."""
    return predictions.groupBy(*keys).agg(F.mode(F.col(value), True).alias(value))


def regrouped_votes(predictions: DataFrame, train: int, val: int | None, keys: list[str] | None = None) -> DataFrame:
    """(keys..., group, pred): votes over the training segments of each validation segment; what is over is dropped.

    A series of s segments of ``train`` units has n = s * train div val groups of s div n segments, or, without ``val``, one.
    """
    keys = ["subject"] if keys is None else keys
    sized = predictions.withColumn("s", F.count("*").over(Window.partitionBy(*keys)))
    sized = sized.withColumn("n", F.lit(1) if val is None else F.floor(F.col("s") * train / val))
    per = sized.where("n > 0").withColumn("per", F.floor(F.col("s") / F.col("n")))
    kept = per.where(F.col("seg") < F.col("per") * F.col("n")).withColumn("group", F.floor(F.col("seg") / F.col("per")).cast("long"))
    return majority(kept, [*keys, "group"])


def product_of_experts(probabilities: DataFrame) -> DataFrame:
    """(subject, class, p): per feature type the sum of ln(p + 1e-12) over segments less its log-sum-exp, then summed and normed.

    Input rows are (subject, kind, seg, class, p).
    """
    sums = probabilities.groupBy("subject", "kind", "class").agg(F.sum(F.ln(F.col("p") + 1e-12)).alias("l"))
    kind, subject = Window.partitionBy("subject", "kind"), Window.partitionBy("subject")
    top = F.max("l").over(kind)
    normed = sums.withColumn("top", top).withColumn("l", F.col("l") - F.col("top") - F.ln(F.sum(F.exp(F.col("l") - F.col("top"))).over(kind)))
    joint = normed.groupBy("subject", "class").agg(F.sum("l").alias("l"))
    high = joint.withColumn("e", F.exp(F.col("l") - F.max("l").over(subject)))
    return high.select("subject", "class", (F.col("e") / F.sum("e").over(subject)).alias("p"))


def f1(rows: DataFrame, keys: list[str], positive: int = 0, weight: Column | None = None) -> DataFrame:
    """F1 of one class by group, 0 where nothing is or is called positive; rows have y and pred."""
    w = F.lit(1.0) if weight is None else weight
    hit, called, there = (F.sum(F.when(c, w).otherwise(0.0)) for c in ((F.col("y") == positive) & (F.col("pred") == positive), F.col("pred") == positive, F.col("y") == positive))
    score = F.coalesce(F.try_divide(2 * hit, called + there), F.lit(0.0)).alias("f1")
    rows_ = F.count("*").alias("n")
    return rows.groupBy(*keys).agg(score, rows_) if keys else rows.agg(score, rows_)


def balanced_accuracy(rows: DataFrame) -> DataFrame:
    """The mean over classes of the weighted recall; rows have y, pred and w."""
    recall = rows.groupBy("y").agg((F.sum(F.when(F.col("y") == F.col("pred"), F.col("w")).otherwise(0.0)) / F.sum("w")).alias("r"))
    return recall.agg(F.avg("r").alias("balanced_accuracy"))


def confusion(rows: DataFrame) -> DataFrame:
    """(y, pred, share): shares of the predictions of each true class."""
    counts = rows.groupBy("y", "pred").agg(F.count("*").alias("n"))
    return counts.select("y", "pred", (F.col("n") / F.sum("n").over(Window.partitionBy("y"))).alias("share"))


def above_thresholds(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """(label, threshold, n): scores above each threshold, by label; all thresholds in one pass."""
    sums = [F.count_if(F.col("score") > t).alias(f"n{i}") for i, t in enumerate(thresholds)]
    wide = rows.groupBy("label").agg(*sums)
    long = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"n{i}").alias("n")) for i, t in enumerate(thresholds)]))
    return wide.select("label", long.alias("x")).select("label", "x.threshold", "x.n")


def with_total(rows: DataFrame) -> DataFrame:
    """(label, n, shortest, longest) by label and, as label null, over all."""
    return rows.rollup("label").agg(F.count("*").alias("n"), F.min("size").alias("shortest"), F.max("size").alias("longest"))


def by_window(results: DataFrame) -> DataFrame:
    """(window, mean, std, n): mean and sample deviation over subjects."""
    return results.groupBy("window").agg(F.avg("score").alias("mean"), F.stddev_samp("score").alias("std"), F.count("*").alias("n"))


def ordered(table: DataFrame, by: str = "window", first: int | None = None) -> DataFrame:
    """A report in order of a column, or its first rows; Spark keeps only those of each task then."""
    rows = table.orderBy(by)
    return rows if first is None else rows.limit(first)


def first_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key, the first by an explicit order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def incomplete_windows(results: DataFrame, subjects: int) -> DataFrame:
    """(window, n): windows whose number of subjects isn't ``subjects``."""
    return results.groupBy("window").agg(F.countDistinct("subject").alias("n")).where(F.col("n") != subjects)


def jackknife(results: DataFrame) -> DataFrame:
    """(window, mean, std) over the means that leave out one subject each, from sums: all minus own."""
    by = Window.partitionBy("window")
    own = results.groupBy("window", "subject").agg(F.sum("score").alias("s"), F.count("score").alias("n"))
    left = own.withColumn("m", F.try_divide(F.sum("s").over(by) - F.col("s"), F.sum("n").over(by) - F.col("n")))
    return left.groupBy("window").agg(F.avg("m").alias("mean"), F.stddev_samp("m").alias("std"))


def best_window(table: DataFrame) -> DataFrame:
    """The window of the highest mean, the smallest of equal ones, with the overall mean and extremes."""
    top = F.max(F.struct(F.round("mean", 9).alias("mean"), (-F.col("window")).alias("w")))
    return table.agg(top.alias("t"), F.avg("mean").alias("overall"), F.min("mean").alias("lowest")).select((-F.col("t.w")).alias("window"), F.col("t.mean").alias("highest"), "overall", "lowest")


def matching(rows: DataFrame, wanted: dict[str, object], ignore: set[str] = frozenset()) -> DataFrame:
    """Rows that equal ``wanted`` in every column it names, except the ignored ones."""
    tests = [F.col(c).eqNullSafe(F.lit(v)) for c, v in wanted.items() if c not in ignore]
    return rows.where(reduce(lambda a, b: a & b, tests, F.lit(True)))


def parsed_name(name: Column) -> list[Column]:
    """Classifier, feature, validation length, filter and training data of a result file's name.

    The fixed names are those of the result files; the longest name that occurs wins.
    """

    def first(names: list[str], default: str) -> Column:
        out = F.lit(default)
        for n in reversed(names):
            out = F.when(F.contains(name, F.lit(n)), F.lit(n)).otherwise(out)
        return out

    # fixed values of the file names, what holds another one first
    filters = ["unnormed-barycenter", "normed-barycenter", "subj_to_subj-resampled", "subj_to_subj", "original-resampled", "original"]
    chosen = first([f"cmmn-{f}" for f in filters], "cmmn-none")
    return [
        first(["random_forest", "ensembled_logistic", "logistic"], "unknown").alias("classifier"),
        first(["bowav_psd_autocorr", "psd_autocorr", "bowav"], "unknown").alias("feature"),
        F.when(name.rlike("_300(_|$)"), "300").when(name.rlike("(?i)_none(_|$)"), "None").otherwise("unknown").alias("validation"),
        F.substring(chosen, 6, 100).alias("filter"),
        F.contains(name, F.lit("clf-trained-on-filtered-data")).alias("trained_on_filtered"),
    ]


def base36(ids: Column, top: int = 34) -> Column:
    """Ids 1 to ``top`` of an array as a bitmap, the first id the highest bit, in base 36."""
    bits = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(top)), lambda i: F.when(F.array_contains(ids, i.cast("int")), "1").otherwise("0")), "")
    return F.conv(bits, 2, 36)


def skip_short(train: int | None, val: int | None, vote: bool) -> bool:
    """Votes need validation segments of at least the training length; the whole series (None) is longest."""
    if not vote or val is None:
        return False
    return train is None or val < train
