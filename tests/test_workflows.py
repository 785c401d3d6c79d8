import pytest

from oscilla.plans import config, learning, workflows


def test_settings_are_checked():
    c = config.configured(config.read_options('--dataset "cue" --feature bowav # comment\n--train-seconds 300 --validation-seconds 300 -1'))
    assert c.validation_seconds == (300.0, -1.0) and c.name == "random_forest_bowav_300_cmmn-None" and c.per_second == pytest.approx(1 / 1.5)
    for wrong in ({"feature": "x"}, {"classifier": "x"}, {"cmmn_filter": "x"}, {"cmmn_filter": "subj_to_subj"}, {"classifier": "ensembled_logistic"}, {"train_seconds": 0}):
        with pytest.raises(ValueError):
            config.EvalConfig("cue", **wrong)
    assert config.rescaled(384, 256, 500) == 750


def test_jobs_read_their_options():
    found = config.job_parser("search").parse_args(config.read_options("--root r --dataset cue --feature bowav --classifier logistic --c 0.1 1 # grid\n--c 1 10"))
    values = config.grid_values(found)
    assert values["c"] == [1.0, 10.0] and values["norm"] == ["l2"] and set(values) == {"aggregate", "expert_weight", "train", "val", "norm", "c", "l1_ratio"}
    forest = config.job_parser("search").parse_args(["--root", "r", "--dataset", "d", "--feature", "psd_autocorr"])
    assert set(config.grid_values(forest)) == {"aggregate", "expert_weight", "train", "val", "min_rows"}
    assert config.job_parser("dictionary").parse_args(["--root", "r", "--dataset", "d", "--class", "3"]).label == 3
    for wrong in (["search"], ["dictionary", "--root", "r"]):
        with pytest.raises(SystemExit):
            config.job_parser(wrong[0]).parse_args(wrong[1:])
    with pytest.raises(ValueError):
        config.job_parser("x")


def test_training_windows_are_capped_filtered_and_cut(spark):
    rows = spark.createDataFrame([(s, i, i % 2, [float(x) for x in range(10)]) for s in range(2) for i in range(6)], "subject int, ic int, label int, samples array<double>")
    out = workflows.training_windows(rows, label=1, cap=2, length=4, seed=1)
    assert out.count() == 2 * 2 * 2 and {tuple(r.v) for r in out.collect()} == {(0, 1, 2, 3), (4, 5, 6, 7)}
    late = workflows.training_windows(rows, label=1, cap=1, length=4, seed=1, taps=[0.0, 1.0])
    assert {tuple(r.v) for r in late.collect()} == {(0, 0, 1, 2), (3, 4, 5, 6)}


def test_votes_need_long_validation_segments(spark):
    codes = spark.createDataFrame([(0, t, t % 2) for t in range(8)], "subject long, t long, code int")
    with pytest.raises(ValueError):
        workflows.voted_predictions(codes, 4, 2)
    assert workflows.pooled_predictions(codes, 4).count() == 2


def test_the_series_of_searches_are_all_users(spark):
    users = {r.user_id for r in spark.read.parquet("/root/testdata/sf0.01/events.parquet").select("user_id").distinct().collect()}
    series = learning._series(spark, "/root/testdata/sf0.01")
    assert len(users) == 150 and {r.ic for r in series.collect()} == users
