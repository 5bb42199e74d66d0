"""Every default setting must be one that its predictor can be fitted with."""

import pytest
from pyspark.sql import functions as F

from tabloom.operators.models import fit
from tabloom.plans.bases import SPACES, default_bases

LIGHT = {"maxIter": 2, "numTrees": 2, "components": 4, "maxDepth": 2}


@pytest.mark.parametrize("classification", [False, True])
def test_defaults_fit(spark, classification):
    df = spark.range(120).select(
        F.col("id"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"),
        (F.col("id") % 3 if classification else F.col("id") * 1.5).cast("double").alias("y"),
    )
    for name, base in default_bases("nll" if classification else "rmse", classification).items():
        values = base.space.decode(base.space.defaults())
        assert values["seed"] == 61
        spec = base.build(values | {k: v for k, v in LIGHT.items() if k in values} | {"seed": 64})
        assert spec.seed == 64 and "seed" not in spec.params and spec.kind == name
        if name == "gbt" and classification:
            spec.params["maxIter"] = 1
        model = fit(spec, df, ["a", "b"], "y", 3 if classification else 0, "id")
        assert model.predict(df).where(F.col("probs" if classification else "p").isNull()).count() == 0


def test_every_default_is_a_value():
    for dims in SPACES.values():
        for d in dims:
            assert d.default in d.values and len(d.shares) == len(d.values) == len(set(d.values))
