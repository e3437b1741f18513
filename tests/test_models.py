"""Additive models against a dense solver, and their statistics against known values."""

import math

import numpy as np
import pytest

from verdantspark.operators import models

FAMILIES = {"binomial": lambda r, m: (r.random(len(m)) < 1 / (1 + np.exp(-2 * m))).astype(float), "poisson": lambda r, m: r.poisson(np.exp(m)).astype(float), "gamma": lambda r, m: r.gamma(4, np.exp(m) / 4) + 1e-3, "inv_gauss": lambda r, m: r.wald(np.exp(m), 4.0)}


def data(family):
    rng = np.random.default_rng(3)
    x = np.sort(rng.random(400))
    return x, FAMILIES[family](rng, np.sin(5 * x) + 0.3)


def dense(x, y, family, lam, n=12, weight=None, rounds=100):
    """The same penalised fit with all rows in one matrix."""
    link, inverse, slope, variance, _ = models.FAMILIES[family]
    s = models.Spline(x.min(), x.max(), n)
    b = np.column_stack([np.ones(len(x)), s.basis(x)])
    p = np.zeros((n + 1, n + 1))
    p[1:, 1:] = lam * s.penalty()
    p += math.sqrt(np.finfo(float).eps) * np.eye(n + 1)
    mu = (y + 0.5) / 2 if family == "binomial" else np.maximum(y, 0.1)
    eta = link(mu)
    for _ in range(rounds):
        w = 1 / (slope(mu) ** 2 * variance(mu)) * (1 if weight is None else weight)
        coef = np.linalg.solve((b * w[:, None]).T @ b + p, b.T @ (w * (eta + slope(mu) * (y - mu))))
        eta = b @ coef
        mu = inverse(eta)
    return mu


@pytest.mark.parametrize("family", sorted(FAMILIES))
def test_family(spark, family):
    x, y = data(family)
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)), "x double, y double")
    model = models.fit_gam(df, "x", "y", splines=12, lams=[0.5], family=family, tol=1e-6)
    mu = dense(x, y, family, 0.5)
    assert np.allclose(model.predict(x), mu, rtol=1e-4)
    s = model.statistics
    scale = s["scale"]
    lgamma = np.vectorize(math.lgamma)
    want = {
        "binomial": lambda: (y * np.log(mu) + (1 - y) * np.log(1 - mu)).sum(),
        "poisson": lambda: (y * np.log(mu) - mu - lgamma(y + 1)).sum(),
        "gamma": lambda: ((1 / scale) * np.log(y / (mu * scale)) - y / (mu * scale) - np.log(y) - math.lgamma(1 / scale)).sum(),
        "inv_gauss": lambda: (0.5 * np.log(1 / (2 * np.pi * scale * y**3)) - (y - mu) ** 2 / (2 * mu**2 * y * scale)).sum(),
    }[family]()
    assert math.isclose(s["loglikelihood"], want, rel_tol=1e-4) and s["n"] == 400 and 0 < s["pseudo_r2"] < 1
    assert 2 < s["edof"] < 13 and all(0 <= p <= 1 for p in model.p_values().values()) and (model.standard_errors() > 0).all()
    assert model.logs["diffs"][-1] < 1e-6 and len(model.logs["deviance"]) == len(model.logs["diffs"])
    assert dict(model.summary())["edof"] == s["edof"]
    if family == "binomial":
        assert s["accuracy"] == ((mu > 0.5) == (y > 0.5)).mean()


def test_grid_in_one_fit(spark):
    """All penalties in one fit give what each gives alone."""
    x, y = data("poisson")
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)), "x double, y double")
    lams = [0.01, 1.0, 100.0]
    alone = [models.fit_gam(df, "x", "y", splines=12, lams=[k], family="poisson") for k in lams]
    best = min(alone, key=lambda m: m.statistics["score"])
    model = models.fit_gam(df, "x", "y", splines=12, lams=lams, family="poisson")
    assert model.statistics["lam"] == best.statistics["lam"] and np.allclose(model.coef, best.coef, rtol=1e-3, atol=1e-4)


def test_bad_penalty_is_left_out(spark):
    x, y = data("poisson")
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)), "x double, y double")
    assert models.fit_gam(df, "x", "y", splines=12, lams=[math.inf, 1.0, math.nan], family="poisson").statistics["lam"] == 1.0
    with pytest.raises(ValueError):
        models.fit_gam(df, "x", "y", splines=12, lams=[math.nan])


def test_exposure(spark):
    x, y = data("poisson")
    t = 1.0 + np.arange(400) % 4
    df = spark.createDataFrame(list(zip(x.tolist(), (y * t).tolist(), t.tolist(), strict=True)), "x double, y double, t double")
    model = models.fit_counts(df, "x", "y", "t", splines=12, lams=[0.5], tol=1e-6)
    assert np.allclose(model.predict(x), dense(x, y, "poisson", 0.5, weight=t), rtol=1e-4)


def test_distributions():
    assert math.isclose(models.chi2_above(3.841458820694124, 1), 0.05, rel_tol=1e-9)
    assert math.isclose(models.chi2_above(18.307038053275146, 10), 0.05, rel_tol=1e-9)
    assert math.isclose(models.f_above(4.9646027437307145, 1, 10), 0.05, rel_tol=1e-9)
    assert math.isclose(models.f_above(2.3478775669983114, 10, 20), 0.05, rel_tol=1e-6)
    assert math.isclose(models.student_quantile(0.975, 10), 2.2281388519649385, rel_tol=1e-9)
    assert math.isclose(models.student_quantile(0.975, None), 1.959963984540054, rel_tol=1e-9)
    assert math.isclose(models.student_quantile(0.025, 3), -3.182446305284263, rel_tol=1e-9)


def test_folds_far_from_zero(spark):
    rng = np.random.default_rng(2)
    x = rng.random(200)
    rows = [(float(a + 1e8), float(3 * a + 1e8 + e), i % 5) for i, (a, e) in enumerate(zip(x, rng.normal(size=200) / 10, strict=True))]
    got = models.cv_rmse_r2(spark.createDataFrame(rows, "x double, y double, fold int"), "x", "y").first()
    assert 0.09 < got.rmse < 0.115 and got.r2 > 0.95
