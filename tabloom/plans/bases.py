"""Base predictors with search spaces ready for a race.

The seed is a dimension like any other, so one setting can be trained under
several seeds and their average found by blending.
"""

from __future__ import annotations

from collections.abc import Callable

from tabloom.operators.models import Spec
from tabloom.operators.space import Dim, Space
from tabloom.plans.race import Base

SEEDS = Dim("seed", (61, 62, 63, 64, 65), 61)

#: values and defaults per kind and task; the heavier a value, the lower its share
SPACES: dict[tuple[str, bool], list[Dim]] = {
    ("gbt", False): [
        Dim("maxIter", (20, 50, 100, 200), 50, (2.0, 4.0, 3.0, 1.0)),
        Dim("maxDepth", (2, 3, 4, 5, 6, 8), 5),
        Dim("stepSize", (0.03, 0.05, 0.1, 0.2, 0.3), 0.1),
        Dim("subsamplingRate", (0.5, 0.7, 0.85, 1.0), 1.0),
        Dim("featureSubsetStrategy", ("all", "onethird", "sqrt"), "all"),
        Dim("minInstancesPerNode", (1, 5, 20, 50), 1),
    ],
    ("rf", False): [
        Dim("numTrees", (50, 100, 200), 100, (2.0, 3.0, 1.0)),
        Dim("maxDepth", (4, 6, 8, 10, 12), 8),
        Dim("featureSubsetStrategy", ("all", "onethird", "sqrt"), "onethird"),
        Dim("subsamplingRate", (0.5, 0.7, 1.0), 1.0),
        Dim("minInstancesPerNode", (1, 5, 20), 1),
    ],
    ("kernel_svm", False): [
        Dim("components", (32, 64, 128, 256), 64),
        Dim("gamma", (0.01, 0.03, 0.1, 0.3), 0.1),
        Dim("C", (0.1, 1.0, 10.0), 1.0),
    ],
    ("spline", False): [
        Dim("knots", (3, 5, 8, 12), 5),
        Dim("regParam", (0.0001, 0.001, 0.01, 0.1), 0.01),
        Dim("elasticNetParam", (0.0, 0.5, 1.0), 0.0),
    ],
    ("knn", False): [
        Dim("n_neighbors", (1, 2, 3, 5, 7, 10, 15, 20, 25, 30), 5),
        Dim("weights", ("uniform", "distance"), "uniform"),
        Dim("metric", ("euclidean", "manhattan", "chebyshev"), "euclidean"),
    ],
}
SPACES |= {(kind, True): dims for (kind, _), dims in list(SPACES.items())}
SPACES[("spline", True)] = [
    Dim("knots", (3, 5, 8), 5),
    Dim("hidden", ((10,), (20,), (40,), (20, 10)), (20,)),
    Dim("maxIter", (30, 60, 120), 60),
]


def builder(kind: str, score_name: str) -> Callable[[dict], Spec]:
    """Settings to a spec; the seed leaves the predictor's own parameters."""

    def build(values: dict) -> Spec:
        values = dict(values)
        return Spec(kind, {k: v for k, v in values.items() if k != "seed"}, score_name, values.get("seed", SEEDS.default))

    return build


def default_bases(
    score_name: str, classification: bool, kinds: tuple[str, ...] = ("gbt", "rf", "kernel_svm", "spline", "knn")
) -> dict[str, Base]:
    """Bases of the given kinds for a race on one score."""
    return {
        kind: Base(kind, Space([*SPACES[(kind, classification)], SEEDS]), builder(kind, score_name)) for kind in kinds
    }
