"""Priors: the coordinate step on a quadratic model of the log-likelihood, and the log density.

Steps see the gradient g and curvature h (positive) of the objective's smooth part at beta, in the likelihood's sense:
without a prior the step is g / h.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Prior:
    """No prior: the maximum likelihood step."""

    regularized = False
    #: Whether the objective that steps improve isn't the likelihood plus log_density.
    adaptive = False

    def step(self, g: float, h: float, beta: float, others: Sequence[float] = ()) -> float:
        return g / h

    def log_density(self, beta: float) -> float:
        return 0.0


@dataclass(frozen=True)
class Normal(Prior):
    variance: float = 1.0
    location: float = 0.0
    regularized = True

    def step(self, g, h, beta, others=()):
        return (g - (beta - self.location) / self.variance) / (h + 1 / self.variance)

    def log_density(self, beta):
        return -0.5 * math.log(2 * math.pi * self.variance) - (beta - self.location) ** 2 / (2 * self.variance)


@dataclass(frozen=True)
class Laplace(Prior):
    variance: float = 1.0
    location: float = 0.0
    regularized = True

    @property
    def rate(self) -> float:
        return math.sqrt(2 / self.variance)

    def step(self, g, h, beta, others=()):
        b = beta - self.location
        target = h * b + g  # of the quadratic in the distance from the location
        return math.copysign(max(abs(target) - self.rate, 0.0), target) / h - b

    def log_density(self, beta):
        return math.log(self.rate / 2) - self.rate * abs(beta - self.location)


@dataclass(frozen=True)
class BrokenAdaptiveRidge(Prior):
    """The fixed point of ridge steps whose penalty is beta**2 / (variance * beta**2): values too close to zero go there."""

    variance: float = 1.0
    regularized = True
    adaptive = True

    def step(self, g, h, beta, others=()):
        penalty = 1 / self.variance
        target = h * beta + g
        if abs(target) < 2 * math.sqrt(penalty * h):
            return -beta
        root = math.sqrt(target * target - 4 * penalty * h)
        return (target + math.copysign(root, target)) / (2 * h) - beta

    def log_density(self, beta):
        return Normal(self.variance).log_density(beta)


@dataclass(frozen=True)
class Jeffreys(Prior):
    """Half the log information is added to the objective; for one covariate. third: the information's derivative over
    twice the information, at beta."""

    third: float = 0.0
    information: float = 1.0
    regularized = True
    adaptive = True

    def step(self, g, h, beta, others=()):
        return (g + self.third) / h

    def log_density(self, beta):
        return 0.5 * math.log(abs(self.information))


@dataclass(frozen=True)
class FusedLaplace(Prior):
    """Absolute pulls towards zero and towards the neighbours' coefficients (given as others)."""

    variance: float = 1.0
    fusion_variance: float = 1.0
    regularized = True

    def step(self, g, h, beta, others=()):
        pulls = [(0.0, math.sqrt(2 / self.variance)), *[(o, math.sqrt(2 / self.fusion_variance)) for o in others]]
        centre = beta + g / h
        stops = sorted({p for p, _ in pulls})
        cost = lambda x: 0.5 * h * (x - centre) ** 2 + sum(r * abs(x - p) for p, r in pulls)
        # Between stops the optimum is the centre moved by the sum of the pulls' signs.
        edges, options = [-math.inf, *stops, math.inf], list(stops)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            inside = a + 1 if b == math.inf else b - 1 if a == -math.inf else (a + b) / 2
            x = centre - sum(math.copysign(r, inside - p) for p, r in pulls) / h
            if a <= x <= b:
                options.append(x)
        return min(options, key=cost) - beta

    def log_density(self, beta):
        return Laplace(self.variance).log_density(beta)


@dataclass(frozen=True)
class HierarchicalNormal(Prior):
    """Normal around the mean of the siblings' group (others: the siblings), which is itself normal around zero. The group's
    mean is integrated out: a group's coefficients are jointly normal, with the class variance as their covariance."""

    variance: float = 1.0
    class_variance: float = 1.0
    regularized = True

    def step(self, g, h, beta, others=()):
        t1, t2, n = 1 / self.variance, 1 / self.class_variance, len(others) + 1
        total = sum(others) + beta
        slope = t1 * beta - t1 * t1 * total / (n * t1 + t2)
        curve = t1 - t1 / (n + t2 / t1)
        return (g - slope) / (h + curve)

    def group_density(self, betas: Sequence[float]) -> float:
        """The log density of a whole group."""
        n, v, c = len(betas), self.variance, self.class_variance
        square = (sum(b * b for b in betas) - c * sum(betas) ** 2 / (v + n * c)) / v
        return -0.5 * (n * math.log(2 * math.pi) + (n - 1) * math.log(v) + math.log(v + n * c) + square)

    def log_density(self, beta):
        return self.group_density([beta])


@dataclass(frozen=True)
class PriorSet:
    """The priors of a fit: one for all, exceptions by covariate, the covariates that are left out, and which others a
    covariate's prior sees (neighbours, or siblings by a map of parents)."""

    default: Prior = field(default_factory=Prior)
    exclude: frozenset[int] = frozenset()
    own: Mapping[int, Prior] = field(default_factory=dict)
    neighbours: Mapping[int, Sequence[int]] = field(default_factory=dict)
    parents: Mapping[int, int] = field(default_factory=dict)
    force_intercept: bool = False
    #: Called instead of a fit, with data, the prior without the hook, control and weights; gives the fit.
    fit_hook: Callable | None = None

    def of(self, covariate: int) -> Prior:
        if covariate in self.own:
            return self.own[covariate]
        if covariate in self.exclude or (covariate == 0 and not self.force_intercept):
            return Prior()
        return self.default

    def seen_by(self, covariate: int) -> list[int]:
        if covariate in self.neighbours:
            return list(self.neighbours[covariate])
        parent = self.parents.get(covariate)
        return [c for c, p in self.parents.items() if p == parent and c != covariate] if parent is not None else []

    @property
    def variances(self) -> dict[str, float]:
        """The hyperparameters of the default prior by name."""
        return {n: getattr(self.default, n) for n in ("variance", "fusion_variance", "class_variance") if hasattr(self.default, n)}

    def with_variance(self, variance: float | Mapping[str, float]) -> PriorSet:
        named = {"variance": variance} if isinstance(variance, int | float) else dict(variance)
        return replace(self, default=replace(self.default, **named))

    def log_density(self, betas: Mapping[int, float]) -> float:
        """The sum over regularised coefficients, or their groups; half of each pair's fusion is counted with each side."""
        total, done = 0.0, set()
        for c, b in betas.items():
            prior = self.of(c)
            if isinstance(prior, HierarchicalNormal):
                if c not in done:
                    group = [c, *[o for o in self.seen_by(c) if o in betas]]
                    done.update(group)
                    total += prior.group_density([betas[o] for o in group])
                continue
            total += prior.log_density(b)
            if isinstance(prior, FusedLaplace):
                rate = math.sqrt(2 / prior.fusion_variance)
                total += sum(0.5 * (math.log(rate / 2) - rate * abs(b - betas[o])) for o in self.seen_by(c) if o in betas)
        return total

    def unknown(self, ids: Sequence[int]) -> list[int]:
        """Excluded covariates that the data don't have."""
        return sorted(set(self.exclude) - set(ids))


def make_prior(kind: str = "none", variance: float | Sequence[float] = 1.0, exclude: Sequence[int] = (), neighbours: Mapping[int, Sequence[int]] | None = None, parents: Mapping[int, int] | None = None, force_intercept: bool = False, cross_validate: bool = False) -> PriorSet:
    """Priors by name: none, laplace, normal, barupdate, jeffreys; with neighbours fused, with parents hierarchical."""
    v = [variance] if isinstance(variance, int | float) else list(variance)
    if cross_validate and kind in ("none", "barupdate", "jeffreys"):
        raise ValueError(f"a prior of kind {kind} has no variance to cross-validate")
    if kind == "hierarchical":
        raise ValueError("a hierarchical prior is a normal one with parents")
    simple = {"none": Prior, "laplace": Laplace, "normal": Normal, "barupdate": BrokenAdaptiveRidge, "jeffreys": Jeffreys}
    if kind not in simple:
        raise ValueError(f"there is no prior of kind {kind}")
    if neighbours is not None:
        if kind != "laplace" or len(v) != 2:
            raise ValueError("a prior with neighbours is a laplace one with two variances")
        default: Prior = FusedLaplace(*v)
    elif parents is not None:
        if kind != "normal" or len(v) != 2:
            raise ValueError("a prior with parents is a normal one with two variances")
        default = HierarchicalNormal(*v)
    else:
        default = Prior() if kind == "none" else Jeffreys() if kind == "jeffreys" else simple[kind](v[0])
    return PriorSet(default, frozenset(exclude), neighbours=neighbours or {}, parents=parents or {}, force_intercept=force_intercept)


def parameterized(function: Callable[[Sequence[float]], Mapping[int, tuple[float, float]]], theta: Sequence[float], kind: str = "laplace") -> PriorSet:
    """Priors whose (location, variance) by covariate are a function of hyperparameters."""
    cls = {"laplace": Laplace, "normal": Normal}[kind]
    return PriorSet(own={c: cls(v, m) for c, (m, v) in function(theta).items()})
