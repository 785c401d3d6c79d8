"""Bags of waveforms: counts and rates of codes by segment, norms, TF-IDF on rates."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bag(codes: DataFrame, *, per_segment: int | None, k: int, rates: bool = True) -> DataFrame:
    """(subject, seg, feature, n, rate): feature = code + book * k, rate = count / samples of the segment.

    Only whole segments count; with None the series is one segment.
    """
    at = codes.withColumn("feature", (F.col("code") + F.col("book") * k).cast("int"))
    if per_segment is None:
        sized = at.withColumn("wps", F.count("*").over(Window.partitionBy("subject", "book"))).withColumn("seg", F.lit(0).cast("long"))
    else:
        whole = F.floor((F.max("t").over(Window.partitionBy("subject")) + 1) / per_segment)
        sized = at.withColumn("seg", F.floor(F.col("t") / per_segment).cast("long")).withColumn("whole", whole).where(F.col("seg") < F.col("whole")).withColumn("wps", F.lit(per_segment).cast("long"))
    out = sized.groupBy("subject", "seg", "feature", "wps").agg(F.count("*").alias("n"))
    return out.select("subject", "seg", "feature", "n", *([(F.col("n") / F.col("wps")).alias("rate")] if rates else []))


def normed(rows: DataFrame, group: list[str], value: str, norm: str | None) -> Column:
    """``value`` over the l1, l2 or max norm of its group; a group of zeros stays zero."""
    if norm is None:
        return F.col(value)
    by = Window.partitionBy(*group)
    sizes = {"l1": F.sum(F.abs(value)).over(by), "l2": F.sqrt(F.sum(F.col(value) * F.col(value)).over(by)), "max": F.max(F.abs(value)).over(by)}
    if norm not in sizes:
        raise ValueError(f"no norm {norm!r}")
    return F.coalesce(F.try_divide(F.col(value), sizes[norm]), F.lit(0.0))


def idf(rates: DataFrame, docs: list[str], *, smooth: bool = True) -> DataFrame:
    """(feature, df, idf): documents in which a feature's rate is above 0, and ln((1 + n) / (1 + df)) + 1, unsmoothed ln(n / df) + 1."""
    n = rates.select(*docs).distinct().agg(F.count("*").alias("n_docs"))
    df = rates.where(F.col("rate") > 0).groupBy("feature").agg(F.count("*").alias("df"))
    one = 1 if smooth else 0
    return df.crossJoin(F.broadcast(n)).select("feature", "df", (F.ln((F.col("n_docs") + one) / (F.col("df") + one)) + 1).alias("idf"))


def left_out_idf(rates: DataFrame, docs: list[str], *, subject: str = "subject", smooth: bool = True) -> DataFrame:
    """(held_out, feature, df, idf): ``idf`` of the documents of all subjects but one, for each of them in turn.

    Frequencies are counted once by subject; those of a split are the total less the held-out subject's. Totals are
    as many numbers as the codebooks have codes and ride along in the plan, so no split reads documents again.
    """
    own = rates.where(F.col("rate") > 0).groupBy(subject, "feature").agg(F.count("*").alias("df"))
    sizes = rates.select(*docs).distinct().groupBy(subject).agg(F.count("*").alias("n"))
    total = [{"feature": r.feature, "df": r.df} for r in own.groupBy("feature").agg(F.sum("df").alias("df")).orderBy("feature").collect()]
    n = sizes.agg(F.sum("n")).first()[0] or 0
    by_subject = own.groupBy(subject).agg(F.map_from_entries(F.collect_list(F.struct("feature", "df"))).alias("own"))
    table = F.from_json(F.lit(json.dumps(total)), "array<struct<feature:int,df:long>>")
    less = F.transform(table, lambda t: F.struct(t["feature"].alias("feature"), (t["df"] - F.coalesce(F.try_element_at("own", t["feature"]), F.lit(0))).alias("df")))
    rows = sizes.join(by_subject, subject, "left").select(F.col(subject).alias("held_out"), (F.lit(n) - F.col("n")).alias("n_docs"), F.inline(less)).where("df > 0")
    one = 1 if smooth else 0
    return rows.select("held_out", "feature", "df", (F.ln((F.col("n_docs") + one) / (F.col("df") + one)) + 1).alias("idf"))


def tfidf(rates: DataFrame, docs: list[str], *, norm: str | None = "l2", use_idf: bool = True, smooth_idf: bool = True, sublinear_tf: bool = False) -> DataFrame:
    """(docs..., feature, w): rates, or 1 + ln of those above 0, times inverse document frequency, each document normed.

    The table of features is as wide as the codebooks, so it joins by broadcast where Spark finds it small.
    """
    if norm not in ("l1", "l2", None):
        raise ValueError(f"no norm {norm!r}")
    tf = F.when(F.col("rate") > 0, 1 + F.ln("rate")).otherwise(F.lit(0.0)) if sublinear_tf else F.col("rate")
    rows = rates.withColumn("v", tf)
    if use_idf:
        rows = rows.join(idf(rates, docs, smooth=smooth_idf), "feature").withColumn("v", F.col("v") * F.col("idf"))
    return rows.select(*docs, "feature", normed(rows, docs, "v", norm).alias("w"))


def joined_features(left: DataFrame, right: DataFrame, keys: list[str], shift: int) -> DataFrame:
    """Two sparse feature tables side by side: rows of keys that both have, the right one's features moved up by ``shift``."""
    both = left.select(*keys).distinct().join(right.select(*keys).distinct(), keys)
    moved = right.withColumn("feature", (F.col("feature") + shift).cast("int"))
    return left.unionByName(moved).join(both, keys, "left_semi")
