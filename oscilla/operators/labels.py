"""Labels, splits, weights, grids and search results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Rows of a table that is sent to every task.
BROADCAST_ROWS = 100_000


def coalesced(expert: Column, probabilities: Column) -> Column:
    """The expert's label, or else the index of the highest probability, the first of equal ones."""
    return F.coalesce(expert, argmax(probabilities))


def argmax(values: Column) -> Column:
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def remapped(label: Column, mapping: dict[int, int]) -> Column:
    """Labels by a table; what it doesn't list is null."""
    out = F.lit(None).cast("int")
    for old, new in mapping.items():
        out = F.when(label == old, F.lit(new)).otherwise(out)
    return out


def role(held_out: Column | int | str) -> Column:
    """The role of a row of (subject, is_expert) where one subject is held out: train, test or null. A search uses this, row by row."""
    held_out = held_out if isinstance(held_out, Column) else F.lit(held_out)
    return F.when(F.col("subject") != held_out, "train").when(F.col("is_expert"), "test")


def leave_one_out(rows: DataFrame) -> DataFrame:
    """(held_out, subject, ic, role): test is the expert rows of the held-out subject, train all rows of the others.

    This writes every split out, a row for each pair of row and subject; searches take ``role`` instead.
    """
    subjects = rows.select(F.col("subject").alias("held_out")).distinct()
    subjects = F.broadcast(subjects) if subjects.count() <= BROADCAST_ROWS else subjects
    both = rows.join(subjects, F.lit(True))
    return both.select("held_out", "subject", "ic", role(F.col("held_out")).alias("role")).where("role is not null")


def split_sizes(rows: DataFrame) -> DataFrame:
    """(held_out, n_train, n_test) of leave-one-subject-out splits, from one count a subject instead of all pairs."""
    counts = rows.groupBy("subject").agg(F.count("*").alias("n"), F.count_if("is_expert").alias("n_test"))
    total = rows.agg(F.count("*").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(F.col("subject").alias("held_out"), (F.col("total") - F.col("n")).alias("n_train"), "n_test")


def expert_weight(weight: float) -> Column:
    return F.when(F.col("is_expert"), F.lit(float(weight))).otherwise(F.lit(1.0))


def balanced_weights(rows: DataFrame) -> DataFrame:
    """(label, n, weight): rows over classes times rows of the class."""
    counts = rows.groupBy("label").agg(F.count("*").alias("n"))
    all_ = counts.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    return counts.crossJoin(F.broadcast(all_)).select("label", "n", (F.col("total") / (F.col("k") * F.col("n"))).alias("weight"))


def grid(spark: SparkSession, values: dict[str, list]) -> DataFrame:
    """(candidate, names...): all combinations, numbered by sorted name, the last name running fastest."""
    names = sorted(values)
    if len(values) and max(len(v) for v in values.values()) > BROADCAST_ROWS:
        raise ValueError(f"a parameter has at most {BROADCAST_ROWS} values")
    parts = [spark.createDataFrame([(i, str(v)) for i, v in enumerate(values[n])], f"`_{n}` int, `{n}` string") for n in names]
    all_ = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)
    number = F.lit(0).cast("long")
    for n in names:
        number = number * len(values[n]) + F.col(f"_{n}")
    return all_.select(number.alias("candidate"), *names)


def jobs(candidates: DataFrame, n_splits: int) -> DataFrame:
    """(job, candidate, split): job = candidate * splits + split."""
    split = F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1)))
    return candidates.select("candidate", split.alias("split")).select((F.col("candidate") * n_splits + F.col("split")).alias("job"), "candidate", "split")


def open_jobs(all_jobs: DataFrame, done: DataFrame) -> DataFrame:
    """Jobs without a result yet, so that a restart goes on where the last run stopped."""
    return all_jobs.join(done, "job", "left_anti")


def cv_table(scores: DataFrame, weight: str | None = None) -> DataFrame:
    """(candidate, mean, std, rank): mean and population deviation over splits, weighted if asked; least rank on ties."""
    if weight:
        w, s = F.sum(weight), F.sum(F.col(weight) * F.col("score"))
        mean = s / w
        std = F.sqrt(F.greatest(F.sum(F.col(weight) * F.col("score") * F.col("score")) / w - mean * mean, F.lit(0.0)))
    else:
        mean, std = F.avg("score"), F.stddev_pop("score")
    table = scores.groupBy("candidate").agg(F.round(mean, 9).alias("mean"), std.alias("std"))
    return table.withColumn("rank", F.rank().over(Window.orderBy(F.desc("mean"))).cast("long"))


def best_candidate(table: DataFrame) -> DataFrame:
    """The lowest candidate of rank 1."""
    return table.where("rank = 1").orderBy("candidate").limit(1)
