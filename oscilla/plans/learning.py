"""Queries that fit models: forests, elastic-net logistic regression, the TF-IDF estimator, searches, evaluations, streams replayed."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..functions import learners, search
from ..operators import bags
from ..sources import signals as src
from ..sources import tables
from ..streaming import live
from .registry import CODES, SIGNAL, registry, rounded

QUERIES, ORACLES, query = registry()


def _rows(spark, d):
    """(subject, seg, features, label, w): dense rates by segment with a label of the subject."""
    rates = bags.bag(src.codes(spark, d), per_segment=16, k=src.K)
    dense = learners.dense(rates, ["subject", "seg"], 2 * src.K)
    return dense.withColumn("label", (F.col("subject") % 3 == 0).cast("double")).withColumn("w", F.when(F.col("subject") % 5 == 0, 3.0).otherwise(1.0))


def _counts(spark, d, classifier):
    rows = _rows(spark, d)
    model = Pipeline(stages=[learners.TfidfRates(), classifier(rows)]).fit(rows)
    return model.transform(rows).groupBy("label", "prediction").agg(F.count("*").alias("n"))


@query("rf_fit_predict")
def rf_fit_predict(spark, d):
    return _counts(spark, d, lambda rows: learners.classifier("random_forest", trees=20, weight="w", seed=13))


@query("logistic_fit_predict")
def logistic_fit_predict(spark, d):
    return _counts(spark, d, lambda rows: learners.classifier("logistic", weight="w", total_weight=rows.agg(F.sum("w")).first()[0], l1_ratio=0.3, c=1.0))


# --- series (subject, ic): each user's events are an ic, three subjects have them all


def _series(spark, d):
    users = src.table(spark, d, "events").select(F.col("user_id").alias("ic")).distinct()
    return users.select((F.col("ic") % 3).alias("subject"), "ic", (F.col("ic") % 7 < 3).cast("int").alias("label"), (F.col("ic") % 4 != 0).alias("is_expert"))


def _bundle(spark, d, kind):
    def of(rows):
        return rows.withColumnRenamed("subject", "ic").withColumn("subject", F.col("ic") % 3)

    return search.bundle(kind, codes=lambda: of(src.codes(spark, d)), samples=lambda: of(src.signal(spark, d)), k=src.K, books=2, srate=8.0)


_LOGISTIC = {"aggregate": "count_pooling", "train": 16, "val": 32, "expert_weight": 2.0, "norm": "l2", "c": 1.0, "l1_ratio": 0.5}


@query("search_best")
def search_best(spark, d):
    """Leave-one-subject-out search over pooling and votes, its results stored, and the best candidate."""
    candidates = [_LOGISTIC, _LOGISTIC | {"aggregate": "majority_vote", "norm": "l1"}]
    features = search.extractor("bowav", _bundle(spark, d, "bowav"))
    results = search.search(spark, features, _series(spark, d), "bowav", "logistic", candidates, tables.new_path(spark, "search"))
    best, score = search.best_of(results, candidates)
    return spark.createDataFrame([(best["aggregate"], best["norm"], score)], "aggregate string, norm string, score double")


@query("loso_idf", f"""with {CODES}, c as (select *, code + book * 16 as feature, t // 16 as seg, (max(t) over (partition by subject) + 1) // 16 as n_whole from codes), bag as (select distinct subject, seg, feature from c where seg < n_whole),
own as (select subject, feature, count(*) as df from bag group by all), n as (select subject, count(*) as n from (select distinct subject, seg from bag) group by subject), total as (select feature, sum(df) as df from own group by feature),
r as (select n.subject as held_out, total.feature, cast(total.df - coalesce(own.df, 0) as bigint) as df, cast((select sum(n) from n) - n.n as bigint) as nd from n cross join total left join own on own.subject = n.subject and own.feature = total.feature)
select held_out, feature, df, round(ln((nd + 1)::double / (df + 1)) + 1, 6) as idf from r where df > 0""")
def loso_idf(spark, d):
    """Document frequencies and idf of every leave-one-subject-out split."""
    rates = bags.bag(src.codes(spark, d), per_segment=16, k=src.K)
    return bags.left_out_idf(rates, ["subject", "seg"]).withColumn("idf", rounded("idf"))


@query("model_pooled")
def model_pooled(spark, d):
    """A model of training segments, stored, loaded and applied to whole validation segments."""
    model, params = _reloaded(spark, d, "bowav", "logistic", _LOGISTIC)
    return search.predictions(model, search.extractor("bowav", _bundle(spark, d, "bowav")), _series(spark, d), aggregate="count_pooling", train=params["train"], val=params["val"])


@query("model_voted")
def model_voted(spark, d):
    """The same model's predictions of training segments, voted over validation segments."""
    model, params = _reloaded(spark, d, "bowav", "logistic", _LOGISTIC)
    return search.predictions(model, search.extractor("bowav", _bundle(spark, d, "bowav")), _series(spark, d), aggregate="majority_vote", train=params["train"], val=params["val"])


def _reloaded(spark, d, kind, classifier, params):
    path = tables.new_path(spark, "model")
    search.save(search.refit(search.extractor(kind, _bundle(spark, d, kind)), _series(spark, d), kind, classifier, params), params, path)
    return search.load(spark, path)


@query("evaluate_sweep")
def evaluate_sweep(spark, d):
    """F1 by length and subject for a forest on both features and an ensemble of two regressions, in one table."""
    series = _series(spark, d)
    made = {kind: search.once(search.extractor(kind, _bundle(spark, d, kind))) for kind in ("bowav", "psd_autocorr", "bowav_psd_autocorr")}

    def extract(kind, limit):
        return search.within(made[kind], limit)

    def run(config):
        kinds = ["bowav", "psd_autocorr"] if config["classifier"] == "ensembled_logistic" else [config["feature"]]
        params = {"train": 16, "expert_weight": 2.0} | ({"trees": 10} if config["classifier"] == "random_forest" else {"c": 1.0})
        name = config["classifier"].removeprefix("ensembled_")
        models = {k: search.refit(extract(k, None), series, k, name, params | ({"bag_width": 2 * src.K} if k == "bowav_psd_autocorr" else {})) for k in kinds}
        return search.evaluated(models, extract, series, [8, 16, 32], aggregate=config["aggregate"], train=16)

    configs = [
        {"classifier": "random_forest", "feature": "bowav_psd_autocorr", "aggregate": "majority_vote"},
        {"classifier": "ensembled_logistic", "feature": "bowav_psd_autocorr", "aggregate": "count_pooling"},
    ]
    return search.sweep(configs, run)


_NOISY = f"""with {SIGNAL}, ics as (select subject as ic, subject % 3 as subject, t, x from signal), n as (select ic, count(*) as n from ics group by ic),
noisy as (select v as length, subject, ic, avg((x > 50)::integer) as p from ics join n using (ic), (values (16), (48), (64)) l(v) where n >= v and t < v group by all)"""


def _noisy(spark, d):
    """A stand-in for the network: the shares of samples above and up to 50."""
    samples = _bundle(spark, d, "psd_autocorr").samples
    return search.labels_by_length(samples, [16, 48, 64], lambda x: np.array([(x > 50).mean(), (x <= 50).mean()]))


@query("labels_by_length", f"{_NOISY} select length, subject, ic, round(p, 6) as p0, cast(case when p >= 1 - p then 0 else 1 end as integer) as label from noisy")
def labels_by_length(spark, d):
    from ..operators.labels import argmax

    return _noisy(spark, d).select("length", "subject", "ic", rounded(F.col("noisy")[0]).alias("p0"), argmax(F.col("noisy")).alias("label"))


_BASELINE = f"""{_NOISY}, r as (select length, subject, (ic % 7 < 3)::integer as y, case when p >= 1 - p then 0 else 1 end as pred from noisy where ic % 4 <> 0),
f as (select length, subject, coalesce(2.0::double * count(*) filter (y = 0 and pred = 0) / nullif(count(*) filter (y = 0) + count(*) filter (pred = 0), 0), 0) as f1, count(*) as n from r group by all)"""


@query("baseline_f1", f"{_BASELINE} select length, subject, round(f1, 6) as f1, n from f")
def baseline_f1(spark, d):
    return search.baseline_f1(_noisy(spark, d), _series(spark, d)).withColumn("f1", rounded("f1"))


@query("baseline_summary", f"{_BASELINE} select length, round(avg(f1), 6) as mean, round(stddev_samp(f1), 6) as std, count(*) as n from f group by length")
def baseline_summary(spark, d):
    return search.summary(search.baseline_f1(_noisy(spark, d), _series(spark, d))).withColumns({"mean": rounded("mean"), "std": rounded("std")})


@query("tfidf_estimator", f"""with {CODES}, c as (select *, code + book * 16 as feature, t // 16 as seg, (max(t) over (partition by subject) + 1) // 16 as n_whole from codes), bag as (select subject, seg, feature, count(*) / 16.0::double as rate from c where seg < n_whole group by all),
f as (select feature, count(*) as df from bag group by feature), n as (select count(*) as nd from (select distinct subject, seg from bag)), v as (select subject, seg, feature, rate * (ln((nd + 1)::double / (df + 1)) + 1) as v from bag join f using (feature), n)
select subject, seg, feature, round(v / sqrt(sum(v * v) over (partition by subject, seg)), 6) as w from v""")
def tfidf_estimator(spark, d):
    out = learners.TfidfRates().fit(_rows(spark, d)).transform(_rows(spark, d))
    return out.select("subject", "seg", F.posexplode(vector_to_array("scaled")).alias("feature", "w")).where("w > 0").withColumn("w", rounded("w"))


@query("stream_tumbling", "select user_id as subject, cast(floor(epoch(ts)) as bigint) // 3600 * 3600 as start, count(*) as n, round(sum(value), 6) as sum_x from events group by all")
def stream_tumbling(spark, d):
    out = live.replayed(spark, f"{d}/events.parquet", live.tumbling_sums, ["subject", "start"])
    return out.select("subject", "start", "n", rounded("sum_x").alias("sum_x"))


@query("stream_bags", "select user_id as subject, event_type as code, cast(floor(epoch(ts)) as bigint) // 7200 * 7200 as start, count(*) as n from events group by all")
def stream_bags(spark, d):
    return live.replayed(spark, f"{d}/events.parquet", live.code_counts, ["subject", "code", "start"])
