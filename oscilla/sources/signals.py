"""Signals, codes, vectors, labelled series and result rows, as views over the tables of an sf folder.

Long form: one row for each sample, (subject, t, x), t counted from 0 in order of time; packed form: one
row for each series with its samples in an array. Sorting by subject and time is one shuffle on the
subject, the key that all later windows and groups use, too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Codes of the first codebook: event types in order of name. The second codebook has K codes.
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
K = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _index(*order: str):
    return (F.row_number().over(Window.partitionBy("subject").orderBy(*order)) - 1).cast("long")


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, t, x): the value of each user's events in order of time."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("subject"), "ts", "event_id", F.col("value").alias("x"))
    return events.select("subject", _index("ts", "event_id").alias("t"), "x")


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, t, book, code): two codes for each sample, by event type and by ``k`` of its properties."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("subject"), "ts", "event_id", "event_type", "props")
    both = F.array(
        F.struct(F.lit(0).alias("book"), (F.array_position(F.lit(EVENT_TYPES), F.col("event_type")) - 1).cast("int").alias("code")),
        F.struct(F.lit(1).alias("book"), (F.get_json_object("props", "$.k").cast("int") % K).alias("code")),
    )
    at = events.select("subject", _index("ts", "event_id").alias("t"), both.alias("both"))
    return at.select("subject", "t", F.explode("both").alias("b")).select("subject", "t", "b.book", "b.code")


#: All columns of order lines in the order that counts.
_LINES = [f"l_{c}" for c in ("shipdate", "orderkey", "linenumber", "partkey", "quantity", "extendedprice", "discount", "tax", "returnflag", "linestatus")]


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, channel, t, x): quantities and taxes in per cent of each supplier's order lines, as two channels."""
    both = F.array(F.col("l_quantity"), F.col("l_tax") * 100)
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("subject"), both.alias("both"), *_LINES).select("subject", _index(*_LINES).alias("t"), "both")
    return rows.select("subject", "t", F.posexplode("both").alias("channel", "x")).select("subject", "channel", "t", "x")


def long_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, t, x): quantities of each supplier's order lines, in order of all columns."""
    lines, order = table(spark, sf_dir, "lineitem"), _LINES
    return lines.select(F.col("l_suppkey").alias("subject"), F.col("l_quantity").alias("x"), *order).select("subject", _index(*order).alias("t"), "x")


def packed(samples: DataFrame) -> DataFrame:
    """(subject, samples): arrays of the samples in order; the inverse of ``unpacked``."""
    gathered = samples.groupBy("subject").agg(F.sort_array(F.collect_list(F.struct("t", "x"))).alias("s"))
    return gathered.select("subject", F.transform("s", lambda s: s["x"]).alias("samples"))


def unpacked(series: DataFrame) -> DataFrame:
    return series.select("subject", F.posexplode("samples").alias("t", "x")).select("subject", F.col("t").cast("long").alias("t"), "x")


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, channel, bin, p): counts of each supplier's lines by year and month, as channel spectra of 12 bins."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("subject"), (F.year("l_shipdate") % 3).alias("channel"), (F.month("l_shipdate") - 1).alias("bin"))
    return lines.groupBy("subject", "channel", "bin").agg(F.count("*").cast("double").alias("p"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, v): embeddings as arrays of doubles."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("v"))


def codebook(spark: SparkSession, sf_dir: str, *, per_class: int = 2, length: int | None = None) -> DataFrame:
    """(class, centroid, c): of each label the first vectors by id, cut to ``length``."""
    vec = vectors(spark, sf_dir)
    rank = F.row_number().over(Window.partitionBy("label").orderBy("id"))
    first = vec.withColumn("r", rank).where(F.col("r") <= per_class)
    c = F.slice("v", 1, length) if length else F.col("v")
    return first.select(F.col("label").alias("class"), (F.col("r") - 1).cast("int").alias("centroid"), c.alias("c"))


def series_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, ic, label, is_expert, guess): documents by source; the expert's label where there is one, a guess from the length otherwise."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", "lang")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    guess = (F.col("n_chars") % 3 != 0).cast("int")
    return docs.join(labels, "doc_id", "left").select(
        F.col("source").alias("subject"), F.col("doc_id").alias("ic"), F.coalesce("quality", guess).alias("label"), F.col("quality").isNotNull().alias("is_expert"), guess.alias("guess"),
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(window, subject, score): one score for each prediction window and subject, as evaluations return them."""
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") % 7).alias("window"), F.col("l_suppkey").alias("subject"), F.round(F.col("l_discount") * 100).cast("long").alias("s"))
    return lines.groupBy("window", "subject").agg((1 - F.sum("s") / F.count("*") / 100).alias("score"))
