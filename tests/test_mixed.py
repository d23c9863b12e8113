"""Mixed models against dense matrices."""

import numpy as np
import pytest

from chirplake.operators import mixed


def plain_linear(x, z, t, w, g, phi, cov, dispersed):
    """ML of a linear mixed model by Fisher scoring on dense matrices."""
    n, q = z.shape
    same = (g[:, None] == g[None, :]).astype(float)
    pairs = [(i, j) for i in range(q) for j in range(i, q)]
    noise = np.diag(1 / w)
    for _ in range(200):
        v = phi * noise + (z @ cov @ z.T) * same
        inv = np.linalg.inv(v)
        beta = np.linalg.solve(x.T @ inv @ x, x.T @ inv @ t)
        r = inv @ (t - x @ beta)
        parts = []
        for i, j in pairs:
            e = np.zeros((q, q))
            e[i, j] = e[j, i] = 1
            parts.append((z @ e @ z.T) * same)
        parts += [noise] if dispersed else []
        score = np.array([0.5 * (r @ d @ r - np.trace(inv @ d)) for d in parts])
        info = np.array([[0.5 * np.trace(inv @ a @ inv @ b) for b in parts] for a in parts])
        step = np.linalg.solve(info, score)
        new = cov.copy()
        for (i, j), d in zip(pairs, step, strict=False):
            new[i, j] = new[j, i] = cov[i, j] + d
        values, vectors = np.linalg.eigh(new)
        new = (vectors * np.maximum(values, 0)) @ vectors.T
        phi = max(phi + step[-1], phi / 10) if dispersed else phi
        if np.abs(new - cov).max() < 1e-11:
            break
        cov = new
    v = phi * noise + (z @ new @ z.T) * same
    inv = np.linalg.inv(v)
    beta = np.linalg.solve(x.T @ inv @ x, x.T @ inv @ t)
    return beta, new, phi, inv


LINKS = {
    "gaussian": (lambda y: y, lambda m: m, lambda e: e, lambda m: np.ones_like(m), lambda m: np.ones_like(m)),
    "poisson": (lambda y: y + 0.1, np.log, np.exp, lambda m: m, lambda m: 1 / m),
    "binomial": (lambda y: (y + 0.5) / 2, lambda m: np.log(m / (1 - m)), lambda e: 1 / (1 + np.exp(-e)), lambda m: m * (1 - m), lambda m: 1 / (m * (1 - m))),
    "gamma": (lambda y: y, lambda m: 1 / m, lambda e: 1 / e, lambda m: m**2, lambda m: -1 / m**2),
}


def plain_fit(x, z, y, g, family):
    start, link, mean, weight, slope = LINKS[family]
    eta, cov, phi, beta = link(start(y)), np.eye(z.shape[1]), 1.0, None
    for _ in range(40):
        mu = mean(eta)
        w, t = weight(mu), eta + (y - mu) * slope(mu)
        new, cov, phi, inv = plain_linear(x, z, t, w, g, phi, cov, family in ("gaussian", "gamma"))
        r = inv @ (t - x @ new)
        effects = {k: cov @ z[g == k].T @ r[g == k] for k in np.unique(g)}
        eta = x @ new + np.array([z[i] @ effects[k] for i, k in enumerate(g)])
        if family == "gaussian" or (beta is not None and np.abs(new - beta).max() < 1e-10):
            return new, cov, phi, effects, np.sqrt(np.diag(np.linalg.inv(x.T @ inv @ x)))
        beta = new
    return new, cov, phi, effects, np.sqrt(np.diag(np.linalg.inv(x.T @ inv @ x)))


def simulated(family, slope, seed=1):
    rng = np.random.RandomState(seed)
    g = np.repeat(np.arange(15), rng.randint(4, 25, 15))
    a, b = rng.randn(len(g)), rng.rand(len(g))
    effects = rng.randn(15, 2) * np.array([0.5, 0.4 if slope else 0])
    eta = 0.3 + 0.8 * a - 0.5 * b + effects[g, 0] + effects[g, 1] * a
    if family == "gaussian":
        return g, a, b, eta + 0.7 * rng.randn(len(g))
    if family == "poisson":
        return g, a, b, rng.poisson(np.exp(eta)).astype(float)
    if family == "binomial":
        return g, a, b, (rng.rand(len(g)) < 1 / (1 + np.exp(-eta))).astype(float)
    mean = 1 / (3.0 + 0.4 * a - 0.3 * b + 0.3 * effects[g, 0])
    return g, a, b, rng.gamma(8.0, mean / 8.0)


@pytest.mark.parametrize(("family", "slope"), [("gaussian", False), ("gaussian", True), ("poisson", False), ("binomial", False), ("gamma", False), ("poisson", True)])
def test_mixed_models_are_the_plain_ones(spark, family, slope):
    g, a, b, y = simulated(family, slope)
    rows = [(f"g{k}", *map(float, v)) for k, *v in zip(g, a, b, y, strict=True)] + [("g0", None, 1.0, 2.0), (None, 1.0, 1.0, 2.0)]
    model = mixed.fit_mixed(spark.createDataFrame(rows, "`site.id` string, a double, b double, y double"), "y", ["a", "b"], "site.id", slope, family)
    x = np.column_stack([np.ones(len(g)), a, b])
    beta, cov, phi, effects, errors = plain_fit(x, x[:, : 2 if slope else 1], y, g, family)
    assert model.converged
    np.testing.assert_allclose(model.coefficients, beta, atol=1e-6)
    np.testing.assert_allclose(model.covariance, cov, atol=1e-5)
    np.testing.assert_allclose(model.errors, errors, atol=1e-5)
    assert model.dispersion == pytest.approx(phi, abs=1e-5)
    got = {r[0]: r[1] for r in model.effects.collect()}
    for k, e in effects.items():
        np.testing.assert_allclose(got[f"g{k}"], e, atol=1e-5)
    assert [s[0] for s in model.summary()] == ["(Intercept)", "a", "b"] and model.formula == f"y ~ a+b+(1{'+a' if slope else ''}|site.id)"


def test_no_variance_between_groups(spark):
    """The covariance ends at nothing, and the fixed effects are those of least squares."""
    rng = np.random.RandomState(0)
    x = rng.randn(200)
    y = 1 + 2 * x + np.tile([0.5, -0.5], 100)
    df = spark.createDataFrame([(int(i // 2 % 10), float(x[i]), float(y[i])) for i in range(200)], "g int, x double, y double")
    model = mixed.fit_mixed(df, "y", ["x"], "g")
    want = np.linalg.lstsq(np.column_stack([np.ones(200), x]), y, rcond=None)[0]
    np.testing.assert_allclose(model.coefficients, want, atol=1e-6)
    assert model.covariance[0, 0] < 1e-6


def test_wrong_models(spark):
    df = spark.createDataFrame([(1, 1.0)], "g int, y double")
    for wrong in ({"family": "none"}, {"slope": True}):
        with pytest.raises(ValueError):
            mixed.fit_mixed(df, "y", [], "g", **wrong)
