import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotrace.functions.gamma import digamma_sql, lgamma_sql, lower_incomplete, trigamma_sql
from spotrace.operators import stats

SCHEMA = "datum int, dwell_s double"


def test_ties_get_different_ranks(make):
    rows = stats.ecdf(make([(0, 1.0), (0, 2.0), (0, 1.0)], SCHEMA)).orderBy("rank").collect()
    assert [(r["dwell_s"], r["p"]) for r in rows] == [(1.0, 1 / 3), (1.0, 2 / 3), (2.0, 1.0)]


def test_common_dwell_time_is_ranked_in_blocks(make, monkeypatch):
    monkeypatch.setattr(stats, "TIE_BLOCK", 7)
    rows = stats.ecdf(make([(0, 3.0)] * 50 + [(0, 1.0)], SCHEMA)).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 52)) and rows[-1]["p"] == 1.0


def test_moments(make):
    t = np.array([1.0, 4.0, 4.0, 9.0])
    row = stats.dwell_moments(stats.dwell_counts(make([(0, float(v)) for v in t], SCHEMA))).first()
    assert row["n_min"] == pytest.approx(t.mean() ** 2 / t.var())


def test_special_functions(make):
    xs = [0.05, 0.5, 1.0, 2.5, 40.0, 900.0]
    df = make([(x,) for x in xs], "a double").select(
        "a", F.expr(lgamma_sql("a")).alias("lg"), F.expr(digamma_sql("a")).alias("dg"), F.expr(trigamma_sql("a")).alias("tg")
    )
    for r in df.collect():
        h = 1e-5 * r["a"]
        assert r["lg"] == pytest.approx(math.lgamma(r["a"]), rel=1e-10, abs=1e-10)
        slope = (math.lgamma(r["a"] + h) - math.lgamma(r["a"] - h)) / (2 * h)
        assert r["dg"] == pytest.approx(slope, rel=1e-5, abs=1e-5)
    one = df.filter("a = 1.0").first()
    assert one["dg"] == pytest.approx(-0.5772156649015329, abs=1e-10)
    assert one["tg"] == pytest.approx(math.pi ** 2 / 6, abs=1e-9)


def test_incomplete_gamma():
    z = np.array([-1.0, 0.0, 0.2, 1.0, 3.0, 20.0])
    assert np.allclose(lower_incomplete(np.ones(6), z), np.where(z > 0, 1 - np.exp(-z), 0))
    erf = [math.erf(math.sqrt(v)) if v > 0 else 0 for v in z]
    assert np.allclose(lower_incomplete(np.full(6, 0.5), z), erf)


def test_fit_recovers_parameters(make):
    rng = np.random.default_rng(11)
    rows = [(0, float(v)) for v in 5 + rng.gamma(3.0, 2.0, size=6000)]
    rows += [(1, float(v)) for v in rng.gamma(1.5, 10.0, size=6000)]
    rows += [(2, 4.0)] * 5
    fitted = {r["datum"]: r for r in stats.fit_summary(make(rows, SCHEMA)).collect()}
    assert fitted[0]["shape"] == pytest.approx(3.0, rel=0.15) and fitted[0]["scale"] == pytest.approx(2.0, rel=0.15)
    assert fitted[0]["loc"] == pytest.approx(5.0, abs=0.5)
    assert fitted[1]["shape"] == pytest.approx(1.5, rel=0.1) and fitted[1]["scale"] == pytest.approx(10.0, rel=0.1)
    assert fitted[0]["r2"] > 0.999 and fitted[1]["r2"] > 0.999
    assert fitted[2]["shape"] is None and fitted[2]["n_min"] is None and fitted[2]["n"] == 5


def test_r_squared_matches_row_by_row(make):
    rng = np.random.default_rng(12)
    t = np.sort(np.round(rng.gamma(2.0, 5.0, size=300)))
    counts = stats.dwell_counts(make([(0, float(v)) for v in t], SCHEMA))
    curve = stats.fitted_curve(counts, stats.gamma_fit(counts))
    f = {r["dwell_s"]: r["fit"] for r in curve.collect()}
    p = np.arange(1, 301) / 300
    want = 1 - ((p - np.array([f[v] for v in t])) ** 2).sum() / ((p - p.mean()) ** 2).sum()
    assert stats.r_squared(curve).first()["r2"] == pytest.approx(want, abs=1e-10)


def plain_series(a, z):
    """The power series in extended precision, as many terms as it takes."""
    a, z = np.longdouble(a), np.longdouble(z)
    # Stirling's series; shapes here are large.
    log = a * np.log(z / a) - (z - a) + np.log(a / (2 * np.longdouble(np.pi))) / 2 - 1 / (12 * a) + 1 / (360 * a**3)
    term = total = 1 / a
    k = 0
    while term > total * np.longdouble(1e-20):
        k += 1
        term *= z / (a + k)
        total += term
    return float(total * np.exp(log))


@pytest.mark.parametrize("shape", [500.0, 2_000.0, 1e5, 1e6, 1e8])
def test_large_shapes_equal_the_series(shape):
    offsets = np.array([-9.0, -4.0, -1.0, -0.01, 0.0, 0.3, 2.0, 5.0])
    z = shape + offsets * np.sqrt(shape)
    got = lower_incomplete(np.full(len(z), shape), z)
    assert np.all(np.diff(got) > 0)
    for value, at in zip(got, z):
        assert value == pytest.approx(plain_series(shape, at), abs=1e-10)
    assert lower_incomplete(np.array([shape, shape, 2.0]), np.array([shape * 0.1, shape * 5, 1e9])).tolist() == [0.0, 1.0, 1.0]


def test_fit_tells_bounds_and_slope(make):
    rng = np.random.default_rng(21)
    rows = [(0, float(v)) for v in 5 + rng.gamma(4.0, 2.0, size=4000)] + [(1, float(v)) for v in rng.exponential(3.0, size=4000)]
    fit = {r["datum"]: r for r in stats.gamma_fit(stats.dwell_counts(make(rows, SCHEMA))).collect()}
    assert not fit[0]["at_bound"] and abs(fit[0]["gradient"]) < 0.05
    for d, r in fit.items():  # the slope against a difference quotient of the likelihood
        x = np.array([v for k, v in rows if k == d])
        span, h = x.max() - x.min(), 1e-6

        def likelihood(loc):
            e = x - loc
            return ((r["shape"] - 1) * np.log(e) - e / r["scale"]).mean()

        slope = (likelihood(r["loc"] + h) - likelihood(r["loc"] - h)) / (2 * h) * span
        assert r["gradient"] == pytest.approx(slope, rel=1e-3, abs=1e-3)
