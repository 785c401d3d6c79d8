"""TF-IDF on rates: parameters, fixtures, edge cases, pipelines."""

import math

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors

from oscilla.functions.learners import TfidfRates, TfidfRatesModel
from oscilla.operators import bags

RATES = [[0.5, 0, 0.25, 0, 0.25], [0, 0.33, 0.33, 0.33, 0], [0.4, 0.2, 0, 0.4, 0], [0, 0, 0.5, 0.25, 0.25]]


def frame(spark, rows):
    return spark.createDataFrame([(i, Vectors.dense(r)) for i, r in enumerate(rows)], ["i", "features"])


def expected(rows, norm="l2", use_idf=True, smooth_idf=True, sublinear_tf=False):
    x = np.array(rows, float)
    tf = np.where(x > 0, 1 + np.log(np.where(x > 0, x, 1)), 0) if sublinear_tf else x
    df, n, one = (x > 0).sum(0), len(x), int(smooth_idf)
    idf = np.log((n + one) / (df + one)) + 1 if use_idf else np.ones(x.shape[1])
    out = tf * idf
    size = {"l2": np.sqrt((out**2).sum(1)), "l1": np.abs(out).sum(1), "none": np.ones(n)}[norm]
    return out / np.where(size > 0, size, 1)[:, None]


@pytest.mark.parametrize("use_idf", [True, False])
@pytest.mark.parametrize("norm", ["l1", "l2", "none"])
@pytest.mark.parametrize("sublinear_tf", [True, False])
def test_estimator_equals_numpy(spark, use_idf, norm, sublinear_tf):
    how = dict(norm=norm, use_idf=use_idf, sublinear_tf=sublinear_tf)
    df = frame(spark, RATES)
    got = TfidfRates(**how).fit(df).transform(df).orderBy("i").collect()
    assert np.allclose([r.scaled.toArray() for r in got], expected(RATES, **how))


def test_defaults_and_parameters():
    t = TfidfRates()
    assert [t.getOrDefault(p) for p in (t.norm, t.use_idf, t.smooth_idf, t.sublinear_tf)] == ["l2", True, True, False]
    assert t.setParams(norm="l1") is t and t.getOrDefault(t.norm) == "l1"
    with pytest.raises(ValueError):
        TfidfRates(norm="l3")
    assert t.copy().getOrDefault(t.norm) == "l1"


@pytest.mark.parametrize("rows", [[[0.5, 0, 0], [0, 0.3, 0], [0.4, 0, 0]], [[0.5, 0.3, 0.2]], [[0.5], [0.3], [0.2]], [[1e-6, 0, 1e-8], [0, 1e-7, 1e-6]], [[0.0, 0.0]]])
def test_edge_cases_have_no_nan(spark, rows):
    df = frame(spark, rows)
    model = TfidfRates().fit(df)
    out = np.array([r.scaled.toArray() for r in model.transform(df).orderBy("i").collect()])
    assert np.isfinite(out).all() and np.allclose(out, expected(rows))
    assert len(model.idf) == len(rows[0]) == len(model.feature_names()) and min(model.idf) > 0


def test_leading_part_only(spark):
    df = frame(spark, RATES)
    got = np.array([r.scaled.toArray() for r in TfidfRates(width=3).fit(df).transform(df).orderBy("i").collect()])
    assert np.allclose(got[:, 3:], np.array(RATES)[:, 3:]) and np.allclose((got[:, :3] ** 2).sum(1), 1)


def test_sparse_equals_dense(spark):
    sparse = spark.createDataFrame([(i, Vectors.sparse(5, [(k, v) for k, v in enumerate(r) if v])) for i, r in enumerate(RATES)], ["i", "features"])
    assert np.allclose(TfidfRates().fit(sparse).idf, TfidfRates().fit(frame(spark, RATES)).idf)


def test_in_a_pipeline_saved_and_loaded(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(float(i % 2), Vectors.dense(rng.random(6) * 0.5 + (i % 2) * np.eye(6)[0])) for i in range(50)]
    df = spark.createDataFrame(rows, ["label", "features"])
    model = Pipeline(stages=[TfidfRates(), LogisticRegression(featuresCol="scaled", labelCol="label")]).fit(df)
    assert model.transform(df).where("label = prediction").count() > 40
    model.stages[0].save(str(tmp_path / "m"))
    assert TfidfRatesModel.load(str(tmp_path / "m")).idf == model.stages[0].idf


def test_relational_form_on_the_same_rates(spark):
    rows = [(i, k, v) for i, r in enumerate(RATES) for k, v in enumerate(r) if v]
    out = bags.tfidf(spark.createDataFrame(rows, "doc long, feature int, rate double"), ["doc"]).collect()
    want = expected(RATES)
    assert len(out) == len(rows) and all(math.isclose(r.w, want[r.doc, r.feature], rel_tol=1e-12) for r in out)
    with pytest.raises(ValueError):
        bags.tfidf(spark.createDataFrame(rows, "doc long, feature int, rate double"), ["doc"], norm="l3")
