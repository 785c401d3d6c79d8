"""Training, search and evaluation of models, against plain computations over stored predictions."""

import collections

import numpy as np
import pytest
from pyspark.ml.linalg import DenseVector
from pyspark.sql import functions as F

from oscilla.functions import learners, search
from oscilla.operators import labels
from oscilla.sources import tables
from oscilla.streaming import live


@pytest.fixture(scope="module")
def data(spark):
    """Codes that tell the labels apart, for 3 subjects of 4 series; one series is short."""
    rng = np.random.default_rng(1)
    codes, samples, series = [], [], []
    for subject in range(3):
        for ic in range(4):
            label, n = ic % 2, 20 if (subject, ic) == (2, 3) else 48
            series.append((subject, ic, label, ic != 1 or subject == 0))
            for t in range(n):
                codes.append((subject, ic, t, 0, int(rng.integers(0, 3)) + 2 * label))
                samples.append((subject, ic, t, float(np.sin(t * (1 + label)) + 0.1 * rng.normal())))
    codes = spark.createDataFrame(codes, "subject int, ic int, t long, book int, code int").coalesce(2).cache()
    samples = spark.createDataFrame(samples, "subject int, ic int, t long, x double").coalesce(2).cache()
    series = spark.createDataFrame(series, "subject int, ic int, label int, is_expert boolean").coalesce(1).cache()
    return {"codes": codes, "samples": samples, "series": series}


def bundle(data, kind):
    return search.bundle(kind, codes=lambda: data["codes"], samples=lambda: data["samples"], k=5, books=1, srate=8.0)


LOGISTIC = {"aggregate": "majority_vote", "train": 8, "val": 24, "expert_weight": 3.0, "norm": "l2", "c": 10.0, "l1_ratio": 0.2}


def test_bundles_load_what_a_feature_type_needs(data):
    def fail():
        raise AssertionError("not needed")

    assert search.bundle("bowav", codes=lambda: data["codes"], samples=fail, k=5, books=1, srate=8.0).samples is None
    assert search.bundle("psd_autocorr", codes=fail, samples=lambda: data["samples"], k=5, books=1, srate=8.0).codes is None
    with pytest.raises(ValueError):
        search.bundle("spectra", codes=fail, samples=fail, k=5, books=1, srate=8.0)


def test_features_by_segment_and_prefix(data):
    rows = {(r.subject, r.ic, r.seg): r.features.toArray() for r in search.extractor("bowav", bundle(data, "bowav"))(8).collect()}
    assert len(rows) == 11 * 6 + 2 and all(v.sum() == pytest.approx(1) for v in rows.values())
    plain = collections.Counter(r.code for r in data["codes"].where("subject = 1 and ic = 2 and t between 8 and 15").collect())
    assert rows[1, 2, 1].tolist() == [plain[c] / 8 for c in range(5)]
    assert search.extractor("bowav", bundle(data, "bowav"))(None).count() == 12
    assert search.extractor("psd_autocorr", bundle(data, "psd_autocorr"), limit=16)(8).count() == 24
    wide = search.extractor("bowav_psd_autocorr", bundle(data, "bowav_psd_autocorr"))(16).first().features
    assert len(wide) == 205


def test_a_split_is_scored_as_by_hand(spark, data):
    features = search.extractor("bowav", bundle(data, "bowav"))
    seen = []

    def scorer(rows):
        seen.append(sorted(tuple(r) for r in rows.collect()))
        return search.brain_f1(rows)

    got = search.fit_and_score(features, data["series"], 2, "bowav", "logistic", LOGISTIC, scorer)
    own = {k: v for k, v in LOGISTIC.items() if k not in ("aggregate", "val")}
    model = search.fitted(features, data["series"].where("subject <> 2"), "bowav", "logistic", **own)
    one = {(r.ic, r.seg): r.prediction for r in model.transform(features(8).where("subject = 2")).collect()}
    want = []
    for ic in (0, 2, 3):  # the experts' rows of the subject
        segs = sorted(s for i, s in one if i == ic)
        n = len(segs) * 8 // 24
        per = len(segs) // n if n else 0
        for g in range(n):
            votes = collections.Counter(one[ic, s] for s in segs[g * per : (g + 1) * per])
            want.append((float(ic % 2), min(votes, key=lambda v: (-votes[v], v)), 3.0))
    assert seen[0] == sorted(want) and {y for y, *_ in want} == {0.0}
    hit = sum(p == 0 for _, p, _ in want)
    assert got["score"] == pytest.approx(2 * hit / (hit + len(want)) if hit else 0.0) and got["fit_time"] > 0
    with pytest.raises(ValueError):
        search.fit_and_score(features, data["series"], 2, "bowav", "logistic", LOGISTIC | {"val": 4})
    with pytest.raises(ValueError):
        search.fit_and_score(features, data["series"], 2, "bowav", "logistic", LOGISTIC | {"aggregate": "mean"})


def test_a_search_reads_the_source_once_for_each_length(spark, data):
    plain, asked = search.extractor("bowav", bundle(data, "bowav")), []

    def features(length):
        asked.append(length)
        return plain(length)

    candidates = [LOGISTIC | {"aggregate": a, "val": v, "c": c} for a, v in (("majority_vote", 24), ("count_pooling", 16)) for c in (1.0, 10.0)]
    results = search.search(spark, features, data["series"], "bowav", "logistic", candidates, tables.new_path(spark, "search-once"))
    assert results.count() == 12 and sorted(asked) == [8, 16]


@pytest.mark.parametrize("held_out", [None, 0, 2])
def test_counts_of_a_split_are_those_of_its_rows(spark, data, held_out):
    plain = search.extractor("bowav", bundle(data, "bowav"))
    shared = search.Shared(plain, data["series"])
    rows = [r for r in plain(8).join(data["series"], ["subject", "ic"]).collect() if r.subject != held_out]
    assert shared.frequencies(8, held_out) == [(sum(r.features[f] > 0 for r in rows), len(rows)) for f in range(5)]
    assert shared.classes(8, held_out) == dict(collections.Counter((float(r.label), r.is_expert) for r in rows))
    counted = learners.TfidfRates().fit(spark.createDataFrame([(r.features,) for r in rows], ["features"]))
    assert learners.TfidfRates().known(shared.frequencies(8, held_out)).idf == counted.idf


def test_features_of_prefixes_are_segments_of_the_whole(data):
    for kind in ("bowav", "psd_autocorr"):
        whole = search.once(search.extractor(kind, bundle(data, kind)))
        for limit, length in ((24, 8), (20, 8), (16, 16), (None, 8)):
            got = {(r.subject, r.ic, r.seg): r.features for r in search.within(whole, limit)(length).collect()}
            assert got == {(r.subject, r.ic, r.seg): r.features for r in search.extractor(kind, bundle(data, kind), limit=limit)(length).collect()}
    with pytest.raises(ValueError):
        search.within(whole, 16)(None)


def test_a_search_goes_on_from_stored_results_and_its_model_is_stored_whole(spark, data):
    folder = tables.new_path(spark, "search-test")
    features = search.extractor("bowav", bundle(data, "bowav"))
    candidates = [LOGISTIC, LOGISTIC | {"aggregate": "count_pooling", "norm": "l1"}]
    results = search.search(spark, features, data["series"], "bowav", "logistic", candidates, folder)
    assert results.count() == 6 and {r.held_out for r in results.collect()} == {"0", "1", "2"}

    def never(rows):
        raise AssertionError("all jobs are done")

    again = search.search(spark, features, data["series"], "bowav", "logistic", candidates, folder, scorer=never)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, results.collect()))
    best, score = search.best_of(results, candidates)
    means = [np.mean([r.score for r in results.collect() if r.candidate == c]) for c in range(2)]
    assert score == pytest.approx(max(means)) and best == candidates[int(np.argmax(np.round(means, 9)))]
    with pytest.raises(ValueError):
        search.best_of(search.stored(spark, folder + "-none"), candidates)
    model = search.refit(features, data["series"], "bowav", "logistic", best)
    search.save(model, best, folder + "-model")
    back, params = search.load(spark, folder + "-model")
    assert params == best and isinstance(back.stages[0], learners.TfidfRatesModel)
    pred = [sorted((r.ic, r.seg, r.prediction) for r in m.transform(features(8)).where("subject = 1").collect()) for m in (model, back)]
    assert pred[0] == pred[1]


def test_the_penalty_follows_the_weights(spark):
    assert learners.classifier("logistic", c=2.0, total_weight=50.0).getRegParam() == pytest.approx(0.01)
    with pytest.raises(ValueError):
        learners.classifier("logistic", c=2.0)


def test_evaluation_over_lengths_subjects_and_models(spark, data):
    series = data["series"]

    def extract(kind, limit):
        return search.extractor(kind, bundle(data, kind), limit=limit)

    params = {"train": 8, "expert_weight": 1.0, "c": 10.0}
    models = {k: search.refit(extract(k, None), series, k, "logistic", params) for k in ("bowav", "psd_autocorr")}
    got = search.evaluated({"bowav": models["bowav"]}, extract, series, [4, 16, None], aggregate="majority_vote", train=8).collect()
    assert {(r.length, r.subject) for r in got} == {(n, s) for n in (16, None) for s in range(3)} and {r.n for r in got} == {3, 4}
    one = {(r.subject, r.ic, r.seg): r.prediction for r in models["bowav"].transform(extract("bowav", 16)(8)).collect()}
    truth = {(r.subject, r.ic): r.label for r in series.where("is_expert").collect()}
    for subject in range(3):
        said = {}
        for (s, ic), _ in truth.items():
            if s == subject:
                votes = collections.Counter(one[s, ic, g] for g in range(2))
                said[ic] = min(votes, key=lambda v: (-votes[v], v))
        hit = sum(p == 0 and truth[subject, ic] == 0 for ic, p in said.items())
        all_ = sum(p == 0 for p in said.values()) + sum(truth[subject, ic] == 0 for ic in said)
        assert next(r.f1 for r in got if r.length == 16 and r.subject == subject) == pytest.approx(2 * hit / all_ if all_ else 0)
    both = search.evaluated(models, extract, series, [16], aggregate="count_pooling", train=8).collect()
    logs = {}
    for kind, model in models.items():
        for r in model.transform(extract(kind, 16)(16)).collect():
            p = np.log(r.probability.toArray() + 1e-12)
            logs[r.subject, r.ic] = logs.get((r.subject, r.ic), 0) + p - np.log(np.exp(p).sum())
    for r in both:
        pred = {ic: int(np.argmax(logs[s, ic])) for (s, ic) in truth if s == r.subject}
        hit = sum(p == 0 and truth[r.subject, ic] == 0 for ic, p in pred.items())
        assert r.f1 == pytest.approx(2 * hit / (sum(p == 0 for p in pred.values()) + sum(truth[r.subject, ic] == 0 for ic in pred)))
    with pytest.raises(ValueError):
        search.evaluated({"bowav": models["bowav"]}, extract, series, [4], aggregate="majority_vote", train=8)
    table = search.sweep([{"name": "a", "val": 16}, {"name": "b"}], lambda c: series.select("subject").limit(2))
    assert table.columns == ["name", "val", "subject"] and sorted(str(r.val) for r in table.collect()) == ["16", "16", "None", "None"]
    with pytest.raises(ValueError):
        search.sweep([{"subject": 1}], lambda c: series)


def test_baseline_of_the_network(spark, data):
    noisy = search.labels_by_length(data["samples"], [16, 40], lambda x: np.array([float((x > 0).mean()), float((x <= 0).mean())]))
    assert noisy.count() == 12 + 11
    scores = search.baseline_f1(noisy, data["series"])
    assert {(r.length, r.subject) for r in scores.collect()} == {(n, s) for n in (16, 40) for s in range(3)}
    means = {r.length: r["mean"] for r in search.summary(scores).collect()}
    assert means[16] == pytest.approx(np.mean([r.f1 for r in scores.where("length = 16").collect()]))


def test_roles_are_those_of_the_splits_written_out(data):
    series = data["series"]
    for held_out in range(3):
        own = {(r.subject, r.ic): r.role for r in series.select("subject", "ic", labels.role(held_out).alias("role")).where("role is not null").collect()}
        assert own == {(r.subject, r.ic): r.role for r in labels.leave_one_out(series).where(F.col("held_out") == held_out).collect()}


def test_late_events_are_dropped_and_windows_updated(spark):
    path = tables.new_path(spark, "live-test")
    rows = [(1, "view", 1.0, "2024-01-01 00:10:00"), (1, "view", 2.0, "2024-01-01 06:00:00")], [(1, "view", 4.0, "2024-01-01 06:30:00")], [(1, "view", 16.0, "2024-01-01 09:00:00"), (1, "view", 8.0, "2024-01-01 00:20:00")]
    for k, part in enumerate(rows):
        spark.createDataFrame(part, "user_id long, event_type string, value double, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(f"{path}/part={k}.parquet")
        spark._jvm.java.lang.Thread.sleep(1100)  # files are taken in order of their time
    flat = tables.new_path(spark, "live-flat")
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for k in range(3):
        for status in fs.listStatus(hadoop.Path(f"{path}/part={k}.parquet")):
            if status.getPath().getName().endswith(".parquet"):
                fs.mkdirs(hadoop.Path(flat))
                fs.rename(status.getPath(), hadoop.Path(f"{flat}/events-{k}.parquet"))
    got = {r.start % 86400 // 3600: (r.n, r.sum_x) for r in live.replayed(spark, f"{flat}/events-*.parquet", live.tumbling_sums, ["subject", "start"]).collect()}
    assert got == {0: (1, 1.0), 6: (2, 6.0), 9: (1, 16.0)}  # the event of 00:20 came after its window was closed


def test_no_node_below_the_minimum_is_split(spark):
    rng = np.random.default_rng(0)
    points = rng.normal(size=(300, 4))
    df = spark.createDataFrame([(DenseVector(v), float(v.sum() > 0)) for v in points], ["features", "label"]).coalesce(2)
    common = {"trees": 5, "depth": 6, "seed": 3, "features": "features"}
    grown = learners.classifier("random_forest", **common).fit(df)
    cut = learners.classifier("random_forest", min_split=40, **common).fit(df)

    def nodes(model):
        path = tables.new_path(spark, "forest-test")
        model.save(path)
        return {(r.treeID, r.nodeData.id): r.nodeData for r in spark.read.parquet(f"{path}/data").collect()}

    before, after = nodes(grown), nodes(cut)
    inner = [n for n in after.values() if n.leftChild >= 0]
    assert inner and all(n.rawCount >= 40 for n in inner) and any(n.rawCount < 40 and n.leftChild >= 0 for n in before.values())
    assert cut.totalNumNodes < grown.totalNumNodes

    def votes(v):
        total = np.zeros(2)
        for tree in range(5):
            n = before[tree, 0]
            while n.leftChild >= 0 and n.rawCount >= 40:
                n = before[tree, n.leftChild if v[n.split.featureIndex] <= n.split.leftCategoriesOrThreshold[0] else n.rightChild]
            total += np.array(n.impurityStats) / sum(n.impurityStats)
        return total / 5

    for r in cut.transform(df).limit(60).collect():
        assert r.probability.toArray() == pytest.approx(votes(r.features.toArray()))


def test_a_search_tries_minimums_of_rows_to_split(spark, data):
    features = search.extractor("bowav", bundle(data, "bowav"))
    base = {"aggregate": "count_pooling", "train": 8, "val": 16, "expert_weight": 1.0, "trees": 3, "depth": 3}
    candidates = [base | {"min_split": m} for m in (2, 12)]
    results = search.search(spark, features, data["series"], "bowav", "random_forest", candidates, tables.new_path(spark, "search-forest"))
    assert results.count() == 6
    model = search.refit(features, data["series"], "bowav", "random_forest", candidates[1])
    search.save(model, candidates[1], folder := tables.new_path(spark, "forest-model"))
    assert search.load(spark, folder)[0].stages[1].totalNumNodes == model.stages[1].totalNumNodes
