"""Generalised linear mixed models with random effects by group: penalised quasi-likelihood on sums by group."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chirplake.operators.filters import quoted
from chirplake.operators.ingest import stored

#: Groups up to which their effects are broadcast to the rows; above it the two are joined by shuffles.
BROADCAST_GROUPS = 200_000


@dataclass(frozen=True)
class Family:
    """Start of the mean, link, its inverse, weight and derivative of the link at the mean; whether a dispersion is estimated."""

    start: Callable[[Column], Column]
    link: Callable[[Column], Column]
    mean: Callable[[Column], Column]
    weight: Callable[[Column], Column]
    slope: Callable[[Column], Column]
    dispersed: bool


FAMILIES = {
    "gaussian": Family(lambda y: y, lambda m: m, lambda e: e, lambda m: m * 0 + 1, lambda m: m * 0 + 1, True),
    "poisson": Family(lambda y: y + 0.1, F.log, F.exp, lambda m: m, lambda m: 1 / m, False),
    "binomial": Family(lambda y: (y + 0.5) / 2, lambda m: F.log(m / (1 - m)), lambda e: 1 / (1 + F.exp(-e)), lambda m: m * (1 - m), lambda m: 1 / (m * (1 - m)), False),
    "gamma": Family(lambda y: y, lambda m: 1 / m, lambda e: 1 / e, lambda m: m * m, lambda m: -1 / (m * m), True),
    "gamma_log": Family(lambda y: y, F.log, F.exp, lambda m: m * 0 + 1, lambda m: 1 / m, True),
}


@dataclass
class MixedModel:
    """Fixed effects with their standard errors, covariance of the random effects, dispersion, and effects by group."""

    names: list[str]
    coefficients: np.ndarray
    errors: np.ndarray
    covariance: np.ndarray
    dispersion: float
    effects: DataFrame
    passes: int
    converged: bool
    family: str = "gaussian"
    group: str = ""
    formula: str = ""
    random: list[str] = field(default_factory=list)

    def summary(self) -> list[tuple[str, float, float, float]]:
        """(name, estimate, standard error, ratio) of the fixed effects."""
        return [(n, float(b), float(e), float(b / e) if e else float("nan")) for n, b, e in zip(self.names, self.coefficients, self.errors, strict=True)]


def _pairs(n: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(n) for j in range(i, n)]


def sums_by_group(rows: DataFrame, p: int, q: int) -> DataFrame:
    """(g, n, s): weighted sums of products of x (p), z (q of them) and the working response t, as one array a group.

    Plain sums, combined in each task before they are shuffled, so a group of any size is a row a task.
    """
    x = [F.col(f"x{i}") for i in range(p)]
    z = x[:q]  # the random effects are those of the intercept and of the first fixed effect
    products = [x[i] * x[j] for i, j in _pairs(p)] + [a * F.col("t") for a in x] + [F.col("t") * F.col("t")]
    assert len(z) == q
    totals = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("w") * c).alias(f"s{i}") for i, c in enumerate(products)])
    return totals.select("g", "n", F.array(*[f"s{i}" for i in range(len(products))]).alias("s"))


def unpack(sums: np.ndarray, p: int, q: int) -> tuple[np.ndarray, ...]:
    """(xx, xz, zz, xt, zt, tt) of each group."""
    xx = np.zeros((len(sums), p, p))
    for k, (i, j) in enumerate(_pairs(p)):
        xx[:, i, j] = xx[:, j, i] = sums[:, k]
    xt = sums[:, p * (p + 1) // 2 : p * (p + 1) // 2 + p]
    return xx, xx[:, :, :q], xx[:, :q, :q], xt, xt[:, :q], sums[:, -1]


def effects_of(beta: np.ndarray, cov: np.ndarray, phi: float, sums: np.ndarray, p: int, q: int) -> np.ndarray:
    """Random effects of groups, given the rest."""
    _, xz, zz, _, zt, _ = unpack(sums, p, q)
    inner = np.linalg.inv(np.eye(q) + zz @ cov / phi)
    return np.einsum("ij,gjk,gk->gi", cov, inner, (zt - np.einsum("gpq,p->gq", xz, beta)) / phi)


def normal_terms(cov: np.ndarray, phi: float, sums: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over groups of X'V^-1 X and X'V^-1 t."""
    xx, xz, zz, xt, zt, _ = unpack(sums, p, q)
    back = cov @ np.linalg.inv(np.eye(q) + zz @ cov / phi)  # (C / phi + D^-1)^-1, also where D has no inverse
    m = xx.sum(axis=0) / phi - np.einsum("gpi,gij,grj->pr", xz, back, xz) / phi**2
    return m, xt.sum(axis=0) / phi - np.einsum("gpi,gij,gj->p", xz, back, zt) / phi**2


def score_terms(beta: np.ndarray, cov: np.ndarray, phi: float, sums: np.ndarray, n: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over groups of the score and the expected information of (D by pairs, phi)."""
    xx, xz, zz, xt, zt, tt = unpack(sums, p, q)
    left = np.linalg.inv(np.eye(q) + zz @ cov / phi)
    k = left @ zz / phi  # Z'V^-1 Z
    u = np.einsum("gij,gj->gi", left, (zt - np.einsum("gpq,p->gq", xz, beta)) / phi)  # Z'V^-1 r
    b = u @ cov
    squares = tt - 2 * xt @ beta + np.einsum("p,gpr,r->g", beta, xx, beta)
    rest = zt - np.einsum("gpq,p->gq", xz, beta)
    squares = squares - 2 * (b * rest).sum(axis=1) + np.einsum("gi,gij,gj->g", b, zz, b)
    back = cov @ left
    ratio = back @ zz
    middle = left @ zz @ np.swapaxes(left, 1, 2) / phi**2  # Z'V^-1 W^-1 V^-1 Z
    pairs = _pairs(q)
    basis = []
    for i, j in pairs:
        e = np.zeros((q, q))
        e[i, j] = e[j, i] = 1.0
        basis.append(e)
    trace = np.einsum("gii->g", ratio)
    score = [0.5 * (np.einsum("gi,ij,gj->", u, e, u) - np.einsum("gij,ji->", k, e)) for e in basis]
    score.append(0.5 * float((squares / phi**2 - (n / phi - trace / phi**2)).sum()))
    info = np.zeros((len(basis) + 1, len(basis) + 1))
    for a, ea in enumerate(basis):
        for c, ec in enumerate(basis):
            info[a, c] = 0.5 * np.einsum("gij,jk,gkl,li->", k, ea, k, ec)
        info[a, -1] = info[-1, a] = 0.5 * np.einsum("gij,ji->", middle, ea)
    info[-1, -1] = 0.5 * float((n / phi**2 - 2 * trace / phi**3 + np.einsum("gij,gji->g", ratio, ratio) / phi**4).sum())
    return np.array(score), info


def _total(sums: DataFrame, work: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all groups of what ``work`` makes of a batch of them. A row a task reaches the driver, of the size of a model."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = 0
        for batch in batches:
            if len(batch):
                total = total + work(np.stack(batch.s.tolist()), batch.n.to_numpy(float))
        if not isinstance(total, int):
            yield pd.DataFrame({"v": [total.tolist()]})

    return np.sum([r.v for r in sums.mapInPandas(run, "v array<double>").collect()], axis=0)


def variances(sums: DataFrame, beta: np.ndarray, cov: np.ndarray, phi: float, p: int, q: int, dispersed: bool, steps: int, tolerance: float) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """(beta, D, phi, information of beta) of the linear mixed model of the sums, by Fisher scoring.

    A step is one job over groups: fixed effects and variances have no information in common, so both move at once.
    """
    pairs = _pairs(q)
    k = len(pairs) + 1
    free = k if dispersed else k - 1

    def terms(beta: np.ndarray, cov: np.ndarray, phi: float) -> list[np.ndarray]:
        def work(s: np.ndarray, n: np.ndarray) -> np.ndarray:
            return np.concatenate([x.ravel() for x in (*normal_terms(cov, phi, s, p, q), *score_terms(beta, cov, phi, s, n, p, q))])

        got = np.split(_total(sums, work), np.cumsum([p * p, p, k]))
        return [got[0].reshape(p, p), got[1], got[2], got[3].reshape(k, k)]

    for _ in range(steps):
        information, right, score, info = terms(beta, cov, phi)
        new = np.linalg.solve(information, right)
        step = np.linalg.solve(info[:free, :free] + 1e-12 * np.diag(np.diag(info[:free, :free])), score[:free])
        next_cov = cov.copy()
        for (i, j), d in zip(pairs, step, strict=False):
            next_cov[i, j] = next_cov[j, i] = cov[i, j] + d
        values, vectors = np.linalg.eigh(next_cov)
        next_cov = (vectors * np.maximum(values, 0)) @ vectors.T
        next_phi = max(phi + step[-1], phi / 10) if dispersed else phi
        change = max(np.abs(next_cov - cov).max() / (np.abs(cov).max() + 1e-12), abs(next_phi - phi) / phi, np.abs(new - beta).max() / (np.abs(beta).max() + 1e-12))
        beta, cov, phi = new, next_cov, next_phi
        if change < tolerance:
            break
    information, right, _, _ = terms(beta, cov, phi)
    return np.linalg.solve(information, right), cov, phi, information


def fit_mixed(df: DataFrame, response: str, fixed: list[str], group: str, slope: bool = False, family: str = "gaussian", passes: int = 50, steps: int = 30, tolerance: float = 1e-7) -> MixedModel:
    """Fit ``response ~ 1 + fixed + (1 | group)``, or ``(1 + first fixed | group)`` with ``slope``.

    Penalised quasi-likelihood: a pass over the rows makes the working response at the present effects and sums its
    weighted products by group; Fisher scoring on those sums alone gives the fixed effects, the covariance of the random
    ones and the dispersion; and so on until the fixed effects stay. Rows with a null take no part. A gaussian model is
    exact maximum likelihood after one pass; other families are the usual first-order approximation of it. One grouping
    factor; ``gamma`` has the inverse link, ``gamma_log`` that of logarithms. Only sums over groups reach the driver.
    """
    if family not in FAMILIES:
        raise ValueError(f"no family {family}")
    if slope and not fixed:
        raise ValueError("a slope needs a fixed effect")
    f, p, q = FAMILIES[family], 1 + len(fixed), 2 if slope else 1
    x = [F.lit(1.0), *[F.col(quoted(c)).cast("double") for c in fixed]]
    rows = df.select(F.col(quoted(group)).alias("g"), F.col(quoted(response)).cast("double").alias("y"), *[c.alias(f"x{i}") for i, c in enumerate(x)]).dropna()
    beta, cov, phi, effects, sums = None, np.eye(q), 1.0, None, None
    done, converged, information = 0, False, np.eye(p)
    for done in range(1, passes + 1):
        if beta is None:
            eta = f.link(f.start(F.col("y")))
            known = rows
        else:
            few = F.broadcast(effects) if effects.count() <= BROADCAST_GROUPS else effects
            known = rows.join(few, "g")
            eta = sum((F.col(f"x{i}") * F.lit(float(b)) for i, b in enumerate(beta)), F.lit(0.0))
            eta = sum((F.col(f"x{i}") * F.get("b", F.lit(i)) for i in range(q)), eta)
        known = known.withColumn("eta", eta).withColumn("mu", f.mean(F.col("eta")))
        known = known.withColumn("w", f.weight(F.col("mu"))).withColumn("t", F.col("eta") + (F.col("y") - F.col("mu")) * f.slope(F.col("mu")))
        sums = stored(sums_by_group(known, p, q))
        start = beta if beta is not None else np.zeros(p)
        if beta is None:  # before the first step, the fixed effects without random ones
            got = _total(sums, lambda s, _n: np.concatenate([x.ravel() for x in normal_terms(np.zeros((q, q)), 1.0, s, p, q)]))
            start = np.linalg.solve(got[: p * p].reshape(p, p), got[p * p :])
        exact = family == "gaussian"  # else the sums are of effects that aren't right yet, and a few steps do
        new, next_cov, next_phi, information = variances(sums, start, cov, phi, p, q, f.dispersed, steps if exact else min(steps, 3), tolerance)
        change = max(np.abs(new - start).max() / (np.abs(new).max() + 1e-12), np.abs(next_cov - cov).max() / (np.abs(cov).max() + 1e-12), abs(next_phi - phi) / phi)
        beta, cov, phi = new, next_cov, next_phi

        def own(batches: Iterator[pd.DataFrame], beta: np.ndarray = beta, cov: np.ndarray = cov, phi: float = phi) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    yield pd.DataFrame({"g": batch.g, "b": list(effects_of(beta, cov, phi, np.stack(batch.s.tolist()), p, q))})

        effects = stored(sums.select("g", "s").mapInPandas(own, f"g {rows.schema['g'].dataType.simpleString()}, b array<double>"))
        if exact or (done > 1 and change < tolerance):
            converged = True
            break
    random = ["(Intercept)", *fixed[:1]][:q]
    formula = f"{response} ~ " + "+".join([*fixed, f"(1{'+' + fixed[0] if slope else ''}|{group})"])
    errors = np.sqrt(np.diag(np.linalg.inv(information)))
    return MixedModel(["(Intercept)", *fixed], beta, errors, cov, phi, effects.toDF(group, "effects"), done, converged, family, group, formula, random)
