import numpy as np
import pytest
from pyspark.sql import functions as F

from spotrace.functions.chunks import series_stats
from spotrace.operators import series


def column(df, name):
    return [r[name] for r in df.orderBy("datum", "trace_num", "frame").collect()]


def test_gradient_by_hand(samples_of):
    df = series.gradient(samples_of({(0, 1): [0, 0, 1, 3, 3, 2]}))
    assert column(df, "grad") == [0, 0.5, 1.5, 1, -0.5, -1]


def test_single_sample_has_no_gradient(samples_of):
    assert column(series.gradient(samples_of({(0, 1): [4]})), "grad") == [None]


def test_constant_trace_has_no_norm(samples_of):
    df = samples_of({(0, 1): [5, 5, 5], (0, 2): [1, 3, 2]})
    assert column(series.normalize(df), "norm") == [None, None, None, 0.0, 1.0, 0.5]
    assert column(series.normalize(df, "zscore"), "norm")[:3] == [None] * 3


def test_zscore_forms(samples_of):
    values = np.array([1.0, 4.0, 2.0, 8.0])
    df = samples_of({(0, 1): values})
    std = values.std()
    assert np.allclose(column(series.normalize(df, "zscore"), "norm"), (values - values.mean()) / std)
    assert np.allclose(column(series.normalize(df, "zscore_compat"), "norm"), values - values.mean() / std)
    with pytest.raises(ValueError):
        series.normalize(df, "other")


def test_short_trace_has_no_trend(samples_of):
    df = samples_of({(0, 1): range(19), (0, 2): range(20)})
    trends = column(series.trend(df), "trend")
    assert trends[:19] == [None] * 19
    assert [t for t in trends[19:] if t is not None] == [pytest.approx(v) for v in range(5, 15)]


def test_odd_period(samples_of):
    values = np.random.default_rng(1).normal(size=40)
    df = samples_of({(0, 1): values})
    got = column(series.trend(df, period=7), "trend")
    want = [None] * 3 + [values[i - 3:i + 4].mean() for i in range(3, 37)] + [None] * 3
    assert [g is None for g in got] == [w is None for w in want]
    assert np.allclose([g for g in got if g is not None], [w for w in want if w is not None])
    grads = column(series.trend_gradient(df, period=7), "trend_grad")
    numbers = np.array([np.nan if w is None else w for w in want])
    assert np.allclose(np.array(grads, dtype=float), np.gradient(numbers), equal_nan=True)


def test_decompose_adds_up(samples_of):
    values = np.random.default_rng(2).normal(size=95)
    rows = series.decompose(samples_of({(0, 1): values})).orderBy("frame").collect()
    season = np.array([r["seasonal"] for r in rows])
    assert abs(season[:10].sum()) < 1e-9 and np.allclose(season[:80], season[10:90])
    inner = [r for r in rows if r["trend"] is not None]
    assert len(inner) == 85
    assert all(abs(r["trend"] + r["seasonal"] + r["residual"] - r["raw"]) < 1e-9 for r in inner)


@pytest.mark.parametrize("bits", [3, 5])
def test_chunks_do_not_change_results(samples_of, bits):
    rng = np.random.default_rng(bits)
    df = samples_of({(0, t): rng.normal(size=n).cumsum() for t, n in ((1, 200), (2, 8), (3, 33), (4, 19))})
    for op, name in (
        (series.gradient, "grad"), (series.trend, "trend"), (series.trend_gradient, "trend_grad"),
        (series.running_sum, "running"), (series.normalize, "norm"),
    ):
        whole = np.array(column(op(df), name), dtype=float)
        split = np.array(column(op(df, chunk_bits=bits), name), dtype=float)
        assert np.allclose(whole, split, equal_nan=True), name
    for name in ("seasonal", "residual"):
        whole = np.array(column(series.decompose(df), name), dtype=float)
        split = np.array(column(series.decompose(df, chunk_bits=bits), name), dtype=float)
        assert np.allclose(whole, split, equal_nan=True), name


def test_series_stats_match_numpy(samples_of):
    values = np.random.default_rng(3).normal(size=150) + 1e6
    rows = series_stats(samples_of({(0, 1): values}), ("datum", "trace_num"), bits=4).orderBy("chunk").collect()
    assert len(rows) == 10
    for k, r in enumerate(rows):
        assert r["n"] == 150
        assert r["var_samp"] == pytest.approx(values.var(ddof=1))
        assert r["before"] == pytest.approx((values[:16 * k] - values.mean()).sum(), abs=1e-6)


def test_samples_to_arrays_and_back(samples_of):
    df = samples_of({(0, 1): [3, 1, 2], (1, 1): [5]})
    packed = series.pack(df)
    assert {tuple(r["raw"]) for r in packed.collect()} == {(3.0, 1.0, 2.0), (5.0,)}
    assert series.frame_axis(packed).exceptAll(df.select("datum", "trace_num", "frame", F.col("raw"))).isEmpty()
