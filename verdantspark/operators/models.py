"""Imputation models: a line, its cross-validation, and penalised-spline additive models of one feature."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ols_impute(rows: DataFrame, x: str = "mean_ndvi", y: str = "gvi", known: str = "missing") -> DataFrame:
    """rows with y filled where it is missing, from the line fitted on the others; without any to fit, y stays."""
    fit = rows.filter(~F.col(known)).agg(F.regr_slope(y, x).alias("_a"), F.regr_intercept(y, x).alias("_b"))
    line = F.col("_a") * F.col(x) + F.col("_b")
    return rows.join(F.broadcast(fit)).withColumn(y, F.when(F.col(known), line).otherwise(F.col(y))).drop("_a", "_b")


def impute_union(known: DataFrame, predicted: DataFrame) -> DataFrame:
    return known.unionByName(predicted, allowMissingColumns=True)


def cv_rmse_r2(folded: DataFrame, x: str, y: str) -> DataFrame:
    """One row: the mean over folds of the root mean squared error and of R2 of a line fitted on the other folds.

    One aggregate per fold is enough: the other folds' sums are the total's less its own.
    """
    mean = folded.agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"))  # one row; far from the mean, sums of squares would cancel
    folded = folded.join(F.broadcast(mean)).withColumn(x, F.col(x) - F.col("_mx")).withColumn(y, F.col(y) - F.col("_my"))
    sums = {"n": F.count("*"), "sx": F.sum(x), "sy": F.sum(y), "sxx": F.sum(F.col(x) * F.col(x)), "sxy": F.sum(F.col(x) * F.col(y)), "syy": F.sum(F.col(y) * F.col(y))}
    own = folded.groupBy("fold").agg(*[v.alias(k) for k, v in sums.items()])
    both = own.join(F.broadcast(own.agg(*[F.sum(k).alias(f"t{k}") for k in sums])))
    r = {k: F.col(f"t{k}") - F.col(k) for k in sums}
    a = F.try_divide(r["n"] * r["sxy"] - r["sx"] * r["sy"], r["n"] * r["sxx"] - r["sx"] * r["sx"])
    lines = both.withColumn("_a", a).withColumn("_b", F.try_divide(r["sy"] - F.col("_a") * r["sx"], r["n"]))
    sse = F.col("syy") - 2 * F.col("_a") * F.col("sxy") - 2 * F.col("_b") * F.col("sy") + F.col("_a") * F.col("_a") * F.col("sxx") + 2 * F.col("_a") * F.col("_b") * F.col("sx") + F.col("n") * F.col("_b") * F.col("_b")
    sst = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    scored = lines.withColumn("_sse", F.greatest(sse, F.lit(0.0))).withColumn("_sst", sst)
    return scored.agg(F.avg(F.sqrt(F.col("_sse") / F.col("n"))).alias("rmse"), F.avg(1 - F.try_divide("_sse", "_sst")).alias("r2"), F.sum("n").alias("n"))


def aic_from_rmse(scores: DataFrame, features: int = 1) -> DataFrame:
    """scores (rmse, n) with aic = n ln(rmse^2) + 2 (features + 1)."""
    return scores.withColumn("aic", F.col("n") * F.ln(F.col("rmse") * F.col("rmse")) + 2 * (features + 1))


class Spline:
    """Cubic B-splines on equal knots over [low, high], going on as straight lines outside."""

    def __init__(self, low: float, high: float, n: int = 25, order: int = 3) -> None:
        self.low, self.high, self.n, self.order = low, high if high > low else low + 1.0, n, order

    def basis(self, x: np.ndarray) -> np.ndarray:
        u = (np.asarray(x, float) - self.low) / (self.high - self.low)
        inside = self._inside(np.clip(u, 0, 1))
        for end in (0.0, 1.0):  # linear continuation
            out = u < 0 if end == 0 else u > 1
            if out.any():
                h = 1e-5
                at, near = self._inside(np.array([end, end + h if end == 0 else end - h]))
                slope = (near - at) / (h if end == 0 else -h)
                inside[out] = at + slope * (u[out] - end)[:, None]
        return inside

    def _inside(self, u: np.ndarray) -> np.ndarray:
        k = self.n - self.order
        knots = np.arange(-self.order, k + self.order + 1) / k
        u = np.minimum(u, 1 - 1e-12)[:, None]
        b = ((u >= knots[:-1]) & (u < knots[1:])).astype(float)
        for d in range(1, self.order + 1):
            m = b.shape[1] - 1
            b = (u - knots[:m]) / (d / k) * b[:, :m] + (knots[d + 1 : d + 1 + m] - u) / (d / k) * b[:, 1:]
        return b

    def penalty(self) -> np.ndarray:
        d = np.diff(np.eye(self.n), n=2, axis=0)
        return d.T @ d


#: Families: link, inverse link, derivative of the link, variance, deviance.
_EPS = 1e-10
FAMILIES = {
    "normal": (lambda m: m, lambda e: e, lambda m: np.ones_like(m), lambda m: np.ones_like(m), lambda y, m: (y - m) ** 2),
    "binomial": (lambda m: np.log(m / (1 - m)), lambda e: np.clip(1 / (1 + np.exp(-e)), 1e-9, 1 - 1e-9), lambda m: 1 / (m * (1 - m)), lambda m: m * (1 - m), lambda y, m: -2 * (y * np.log(np.maximum(m, _EPS)) + (1 - y) * np.log(np.maximum(1 - m, _EPS)))),
    "poisson": (np.log, lambda e: np.exp(np.clip(e, -30, 30)), lambda m: 1 / m, lambda m: m, lambda y, m: 2 * (np.where(y > 0, y * np.log(np.maximum(y, _EPS) / m), 0) - (y - m))),
    "gamma": (np.log, lambda e: np.exp(np.clip(e, -30, 30)), lambda m: 1 / m, lambda m: m**2, lambda y, m: 2 * ((y - m) / m - np.log(np.maximum(y, _EPS) / m))),
    "inv_gauss": (np.log, lambda e: np.exp(np.clip(e, -30, 30)), lambda m: 1 / m, lambda m: m**3, lambda y, m: (y - m) ** 2 / (m**2 * np.maximum(y, _EPS))),
}


@dataclass
class Gam:
    """A fitted model: an intercept and a spline. `logs` has, for each round of the fit, its deviance and its step."""

    spline: Spline
    coef: np.ndarray
    family: str
    covariance: np.ndarray
    statistics: dict = field(default_factory=dict)
    expectile: float | None = None
    logs: dict = field(default_factory=dict)

    def matrix(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(x)), self.spline.basis(x)])

    def predict(self, x: np.ndarray) -> np.ndarray:
        return FAMILIES[self.family][1](self.matrix(x) @ self.coef)

    def intervals(self, x: np.ndarray, width: float = 0.95, prediction: bool = False) -> np.ndarray:
        """Lower and upper bounds of the mean, or of new values: by the normal quantile where the scale is known, else by
        Student's."""
        return self.quantiles(x, [(1 - width) / 2, (1 + width) / 2], prediction)

    def quantiles(self, x: np.ndarray, shares: list[float], prediction: bool = False) -> np.ndarray:
        b = self.matrix(x)
        var = np.einsum("ij,jk,ik->i", b, self.covariance, b) + (self.statistics["scale"] if prediction else 0)
        free = None if self.family in KNOWN_SCALE else self.statistics["n"] - self.statistics["edof"]
        eta = b @ self.coef
        return FAMILIES[self.family][1](np.column_stack([eta + student_quantile(q, free) * np.sqrt(var) for q in shares]))

    def partial_dependence(self, n: int = 100, term: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """A grid of the feature and a term's part of the linear predictor on it: 0 is the intercept, 1 the spline."""
        x = np.linspace(self.spline.low, self.spline.high, n)
        return x, np.full(n, self.coef[0]) if term == 0 else self.spline.basis(x) @ self.coef[1:]

    def standard_errors(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.covariance), 0))

    def p_values(self) -> dict[str, float]:
        """Wald's test of each term, the spline's coefficients centred: by chi-square where the scale is known, else by F."""
        out = {}
        for name, at in (("intercept", slice(0, 1)), ("spline", slice(1, None))):
            coef, cov = self.coef[at], self.covariance[at, at]
            coef = coef - coef.mean() if name == "spline" else coef
            u, sv, vt = np.linalg.svd(cov)
            keep = sv > sv.max(initial=0) * max(cov.shape) * np.finfo(float).eps
            rank = int(keep.sum())
            score = float(coef @ (vt[keep].T / sv[keep]) @ u[:, keep].T @ coef)
            free = self.statistics["n"] - self.statistics["edof"]
            out[name] = chi2_above(score, rank) if self.family in KNOWN_SCALE else f_above(score / max(rank, 1), rank, free)
        return out

    def summary(self) -> list[tuple[str, float]]:
        """Names and values of all statistics, and the terms' tests."""
        return [*((k, float(v)) for k, v in self.statistics.items()), *((f"p_value_{k}", v) for k, v in self.p_values().items())]

    def sample(self, x: np.ndarray, draws: int, seed: int = 0) -> np.ndarray:
        """Means under coefficients drawn from their approximate posterior."""
        rng = np.random.default_rng(seed)
        return FAMILIES[self.family][1](self.matrix(x) @ rng.multivariate_normal(self.coef, self.covariance, draws).T)


#: Families whose scale is 1, not estimated.
KNOWN_SCALE = ("binomial", "poisson")


def gamma_below(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function: its series, or beyond a + 1 its continued fraction."""
    if x <= 0:
        return 0.0
    head = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-17 * abs(total):
            k += 1
            term *= x / k
            total += term
        return head * total
    return 1 - head * _fraction(lambda i: x + 2 * i + 1 - a, lambda i: -i * (i - a))


def beta_below(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_below(b, a, 1 - x)

    def step(i: int) -> float:
        m = i // 2
        return m * (b - m) * x / ((a + i - 1) * (a + i)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + i - 1) * (a + i))

    head = math.exp(a * math.log(x) + b * math.log(1 - x) - math.lgamma(a) - math.lgamma(b) + math.lgamma(a + b)) / a
    return head * _fraction(lambda i: 1.0, step)


def _fraction(b, a) -> float:
    """1 / (b(0) + a(1) / (b(1) + a(2) / ...)), evaluated from the front."""
    tiny = 1e-300
    f = b(0) or tiny
    c, d = f, 0.0
    for i in range(1, 10_000):
        d = 1 / ((b(i) + a(i) * d) or tiny)
        c = b(i) + a(i) / c or tiny
        f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return 1 / f


def chi2_above(x: float, free: float) -> float:
    return 1 - gamma_below(free / 2, x / 2) if free > 0 else 1.0


def f_above(x: float, free: float, rest: float) -> float:
    return beta_below(rest / 2, free / 2, rest / (rest + free * x)) if x > 0 and free > 0 and rest > 0 else 1.0


def student_quantile(share: float, free: float | None) -> float:
    """The quantile of Student's distribution, of the normal one without degrees of freedom; by bisection."""
    if share < 0.5:
        return -student_quantile(1 - share, free)
    below = (lambda t: (1 + math.erf(t / math.sqrt(2))) / 2) if free is None else (lambda t: 1 - beta_below(free / 2, 0.5, free / (free + t * t)) / 2)
    low, high = 0.0, 1.0
    while below(high) < share and high < 1e12:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < share else (low, mid)
    return low


def log_likelihood(family: str, s: dict[str, float], scale: float) -> float:
    """From a family's sums (see _sums) and its scale. The normal one is at its own best scale."""
    n = s["n"]
    if family == "normal":
        return -n / 2 * (math.log(2 * math.pi * max(s["deviance"] / n, 1e-300)) + 1)
    if family == "binomial":
        return -s["deviance"] / 2
    if family == "poisson":
        return s["y_log_m"] - s["m"] - s["lgamma"]
    if family == "gamma":
        nu = 1 / scale
        return n * (nu * math.log(nu) - math.lgamma(nu)) + nu * s["log_ratio"] - nu * s["ratio"] - s["log_y"]
    return -n / 2 * math.log(2 * math.pi * scale) - 1.5 * s["log_y"] - s["deviance"] / (2 * scale)


def _start(family: str, v: np.ndarray) -> np.ndarray:
    """Means to begin with: near the values, inside the family's range."""
    return np.zeros(len(v)) if family == "normal" else (v + 0.5) / 2 if family == "binomial" else np.maximum(v, 0.1)


def _added(rows: DataFrame, columns: list[str], of, size: int) -> np.ndarray:
    """The sum over all rows of a vector that `of` makes of arrays of the columns; every task adds up its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += of(*(c.to_numpy(zero_copy_only=False) for c in b.columns))
        yield pa.RecordBatch.from_pydict({"k": pa.array(np.arange(size)), "v": total})

    clean = rows.select(*(F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns))).na.drop()
    got = clean.mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(size)
    out[got["k"].to_numpy()] = got["v"].to_numpy()
    return out


def _grams(rows: DataFrame, columns: list[str], spline: Spline, family: str, coefs: np.ndarray | None, expectile: float | None) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Weighted Gram matrix, right-hand side and deviance at each of coefs (None: at the start), in one pass."""
    link, inverse, slope, variance, deviance = FAMILIES[family]
    m, n = spline.n + 1, 1 if coefs is None else len(coefs)

    def of(u: np.ndarray, v: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
        base, out = np.column_stack([np.ones(len(u)), spline.basis(u)]), []
        for k in range(n):
            mu = _start(family, v) if coefs is None else inverse(base @ coefs[k])
            eta = link(mu) if coefs is None else base @ coefs[k]
            w = 1 / (slope(mu) ** 2 * variance(mu)) * (1 if weight is None else weight)
            if expectile is not None and coefs is not None:
                w = w * np.where(v > mu, expectile, 1 - expectile)
            z = eta + slope(mu) * (v - mu)
            out += [((base * w[:, None]).T @ base).ravel(), base.T @ (w * z), [(deviance(v, mu) * (1 if weight is None else weight)).sum()]]
        return np.concatenate(out)

    got = _added(rows, columns, of, n * (m * m + m + 1)).reshape(n, -1)
    return [(g[: m * m].reshape(m, m), g[m * m : m * m + m], float(g[-1])) for g in got]


#: Sums from which statistics are made.
SUMS = ("n", "pearson", "deviance", "null_deviance", "right", "y_log_m", "m", "lgamma", "log_ratio", "ratio", "log_y")


def _sums(rows: DataFrame, columns: list[str], model: Gam, mean: float) -> tuple[dict[str, float], dict[str, float]]:
    """SUMS at the model's means, and at the mean of all values."""
    _, _, _, variance, deviance = FAMILIES[model.family]
    lgamma = np.vectorize(math.lgamma, otypes=[float])

    def of(u: np.ndarray, v: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
        out, w = [], np.ones(len(v)) if weight is None else weight
        for mu in (model.predict(u), np.full(len(v), mean)):
            count, rate = v * w if weight is not None else v, mu * w if weight is not None else mu  # with exposures, rates again are counts
            safe, low = np.maximum(mu, _EPS), np.maximum(v, _EPS)
            out += [len(v), (w * (v - mu) ** 2 / variance(safe)).sum(), (w * deviance(v, safe)).sum(), 0.0, ((mu > 0.5) == (v > 0.5)).sum()]
            out += [(count * np.log(np.maximum(rate, _EPS))).sum(), rate.sum(), lgamma(np.maximum(count, 0) + 1).sum() if model.family == "poisson" else 0.0]
            out += [np.log(low / safe).sum(), (v / safe).sum(), np.log(low).sum()]
        return np.array(out, float)

    got = _added(rows, columns, of, 2 * len(SUMS))
    at, null = (dict(zip(SUMS, part.tolist(), strict=True)) for part in got.reshape(2, -1))
    return at | {"null_deviance": null["deviance"]}, null


def fit_gam(rows: DataFrame, x: str, y: str, splines: int = 25, lams: np.ndarray | None = None, family: str = "normal", expectile: float | None = None, tol: float = 1e-4, rounds: int = 100, weight: str | None = None) -> Gam:
    """Fit by penalised least squares, for other families than normal iterated, for each penalty; the first penalty with the
    smallest generalised cross-validation (binomial and poisson: unbiased risk) wins. `weight` names a column of row weights.

    Data are only ever summed into matrices as large as the basis. A pass over the rows serves all penalties that have not
    converged; the normal family needs one. A penalty whose system can't be solved is left out; if none is left, it raises.
    """
    columns = [x, y] + ([weight] if weight else [])
    known = rows.select(*columns).na.drop()
    first = known.agg(F.min(x), F.max(x), F.count("*"), F.avg(y) if weight is None else F.try_divide(F.sum(F.col(y) * F.col(weight)), F.sum(weight))).first()
    if first[0] is None:
        raise ValueError("there are no rows to fit")
    n, mean, spline = first[2], float(first[3]), Spline(float(first[0]), float(first[1]), splines)
    penalty = np.zeros((splines + 1, splines + 1))
    penalty[1:, 1:] = spline.penalty()
    lams = np.logspace(-5, 5, 20) if lams is None else np.asarray(lams, float)
    ridge = [lam * penalty + math.sqrt(np.finfo(float).eps) * np.eye(splines + 1) for lam in lams]
    once = family == "normal" and expectile is None

    def solved(k: int, g: np.ndarray, r: np.ndarray) -> np.ndarray | None:
        try:
            out = np.linalg.solve(g + ridge[k], r)
        except np.linalg.LinAlgError:
            return None
        return out if np.isfinite(out).all() else None

    start = _grams(known, columns, spline, family, None, expectile)[0]
    coef = {k: c for k in range(len(lams)) if (c := solved(k, *start[:2])) is not None}
    logs: dict[int, dict[str, list]] = {k: {"deviance": [], "diffs": []} for k in coef}
    done: dict[int, tuple] = {}
    todo = sorted(coef)
    for turn in range(rounds):
        if not todo:
            break
        for k, (g, r, deviance) in zip(list(todo), _grams(known, columns, spline, family, np.array([coef[k] for k in todo]), expectile), strict=True):
            new = coef[k] if once else solved(k, g, r)
            if new is None:
                todo.remove(k)
                continue
            step = float(np.linalg.norm(new - coef[k]) / max(np.linalg.norm(new), 1e-12))
            logs[k]["deviance"].append(deviance)
            logs[k]["diffs"].append(step)
            done[k] = (coef[k], g, deviance)  # the matrices are those at these coefficients
            if once or step < tol or turn == rounds - 1:
                todo.remove(k)
            else:
                coef[k] = new
    if not done:
        raise ValueError("no penalty can be fitted")
    best = None
    for k in sorted(done):
        c, g, deviance = done[k]
        inverse = np.linalg.inv(g + ridge[k])
        per_coef = np.diag(inverse @ g)
        edof = float(per_coef.sum())
        score = deviance / n + 2 + 2 * 1.4 * edof / n if family in KNOWN_SCALE else n * deviance / max(n - 1.4 * edof, 1e-9) ** 2
        if best is None or score < best[0]:
            best = (score, k, c, inverse, g, edof, per_coef)
    score, k, c, inverse, g, edof, per_coef = best
    model = Gam(spline, c, family, inverse, {}, expectile, logs[k])
    at, null = _sums(known, columns, model, mean)
    scale = 1.0 if family in KNOWN_SCALE else at["pearson"] / max(n - edof, 1e-9)
    loglik, empty = log_likelihood(family, at, scale), log_likelihood(family, null, scale)
    aic = -2 * loglik + 2 * edof + (2 if family not in KNOWN_SCALE else 0)
    value, vector = np.linalg.eigh(g)  # the intercept and a constant spline are one direction, which the data don't determine
    root = inverse @ (vector * np.sqrt(np.where(value > len(g) * np.finfo(float).eps * value.max(), value, 0)))
    model.covariance = root @ root.T * scale
    model.statistics = {
        "n": n, "lam": float(lams[k]), "edof": edof, "edof_spline": float(per_coef[1:].sum()), "scale": scale, "deviance": at["deviance"], "score": score, "loglikelihood": loglik, "aic": aic, "aicc": aic + 2 * (edof + 1) * (edof + 2) / (n - edof - 2) if n - edof - 2 else math.inf,
        "pseudo_r2": 1 - at["deviance"] / max(at["null_deviance"], 1e-300), "mcfadden": loglik / empty if empty else math.nan, "mcfadden_adjusted": 1 - (loglik - edof) / empty if empty else math.nan,
    }
    if family == "binomial":
        model.statistics["accuracy"] = at["right"] / n
    return model


def fit_counts(rows: DataFrame, x: str, y: str, exposure: str | None = None, **more) -> Gam:
    """A Poisson model of counts; with a column of exposures, of rates, each weighing as much as its exposure."""
    if exposure is None:
        return fit_gam(rows, x, y, family="poisson", **more)
    rated = rows.withColumns({"_rate": F.try_divide(F.col(y), F.col(exposure)), "_exposure": F.col(exposure)})
    return fit_gam(rated, x, "_rate", family="poisson", weight="_exposure", **more)


def fit_quantile(rows: DataFrame, x: str, y: str, quantile: float, rounds: int = 12, **more) -> Gam:
    """An expectile model whose share of values below its curve is near the quantile, by bisection of the expectile."""
    low, high, model = 0.0, 1.0, None
    for _ in range(rounds):
        mid = (low + high) / 2
        model = fit_gam(rows, x, y, expectile=mid, **more)
        share = predict(rows.na.drop(subset=[x, y]), model, x, "_p").agg(F.avg((F.col(y) <= F.col("_p")).cast("double"))).first()[0]
        if abs(share - quantile) < 0.01:
            break
        low, high = (mid, high) if share < quantile else (low, mid)
    return model


def predict(rows: DataFrame, model: Gam, x: str, name: str) -> DataFrame:
    """rows with the model's mean in column `name`."""

    @F.pandas_udf("double")
    def mean(v):
        import pandas as pd

        out = np.full(len(v), np.nan)
        ok = v.notna().to_numpy()
        out[ok] = model.predict(v[ok].to_numpy())
        return pd.Series(out).astype(object).where(ok, None)

    return rows.withColumn(name, mean(F.col(x).cast("double")))


def gam_impute(rows: DataFrame, x: str = "mean_ndvi", y: str = "gvi", known: str = "missing", **more) -> DataFrame:
    """rows with y filled where it is missing, from a spline model fitted on the others."""
    model = fit_gam(rows.filter(~F.col(known)), x, y, **more)
    return predict(rows, model, x, "_mean").withColumn(y, F.when(F.col(known), F.col("_mean")).otherwise(F.col(y))).drop("_mean")
