import numpy as np
import pytest

from oscilla.functions import kernels as K
from oscilla.functions import tabular


def test_welch_of_a_sine_peaks_at_its_frequency_and_keeps_power():
    x = np.sin(2 * np.pi * 8 * np.arange(1024) / 64)
    p = K.welch(x, 64, 64)
    assert p.argmax() == 8 and p.sum() == pytest.approx(0.5, rel=0.01)


def test_resampling_keeps_a_slow_sine_and_the_length():
    x = np.sin(2 * np.pi * np.arange(256) / 128)
    y = K.resampled(x, 125, 64)
    assert len(y) == 500
    assert np.abs(y[60:-60] - np.sin(2 * np.pi * np.arange(500) * 64 / 125 / 128)[60:-60]).max() < 0.02


def test_equal_rates_change_nothing():
    x = np.arange(10.0)
    assert (K.resampled(x, 3, 3) == x).all()


def test_delta_taps_are_the_identity():
    x = np.random.default_rng(0).normal(size=50)
    assert np.allclose(K.causal(x, [1.0]), x)
    assert np.allclose(K.spectral_filtering(x, np.ones(9)), x)


def test_filter_and_its_own_spectrum_give_the_wanted_one():
    p, q = np.linspace(1, 2, 9), np.linspace(3, 1, 9)
    assert np.allclose((np.sqrt(q) / np.sqrt(p)) ** 2 * p, q)


@pytest.mark.parametrize("n, want", [(0, 1), (1, 1), (2, 2), (3, 4), (16, 16), (17, 32)])
def test_next_power_of_2(n, want):
    assert K.next_power_of_2(n) == want


@pytest.mark.parametrize("n", [40, 64, 200, 900])
def test_features_have_200_bounded_values(n):
    x = np.random.default_rng(n).normal(size=n)
    f = K.features(x, 64)
    assert f.shape == (200,) and np.isfinite(f).all() and np.abs(f[:100]).max() <= 0.99 + 1e-6


def test_notches_are_filled_and_the_array_returned_without_scaling():
    p = np.linspace(0, 1, 100)
    p[49] = -20
    out = K.formatted_psd(p.copy(), normalize=False)
    assert out[49] == pytest.approx((p[48] + p[50]) / 2)


def test_constant_series_are_finite():
    assert np.isfinite(K.features(np.zeros(400), 64)).all()


def test_extractors_as_table_functions(spark):
    rng = np.random.default_rng(3)
    x = {name: rng.normal(size=n) for name, n in (("a", 640), ("b", 256), ("c", 200))}
    rows = [(name, t, float(v)) for name, own in x.items() for t, v in enumerate(own)]
    rng.shuffle(rows)
    spark.createDataFrame([(n, int(t), float(v)) for n, t, v in rows], "who string, t long, x double").createOrReplaceTempView("series_of_test")
    tabular.register(spark)
    for name, extract in tabular.EXTRACTORS.items():
        found = spark.sql(f"select * from series_features(table(series_of_test) partition by (who) order by (t), 64.0D, '{name}')")
        assert found.dtypes == [("who", "string"), ("i", "int"), ("v", "double")]
        got = {(r.who, r.i): r.v for r in found.collect()}
        want = {(who, i): float(v) for who, own in x.items() for i, v in enumerate(extract(own, 64.0))}
        assert got == pytest.approx(want)
    for call in ("'x', 64.0D, 'features'", "table(series_of_test) partition by (who), -1.0D, 'features'", "table(series_of_test) partition by (who), 64.0D, 'pitch'", "table(select t, x from series_of_test) partition by (t), 64.0D, 'features'"):
        with pytest.raises(Exception):
            spark.sql(f"select * from series_features({call})").collect()
