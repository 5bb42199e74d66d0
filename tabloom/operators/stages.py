"""Base classes for user stages of a preparation chain.

A stage is a ``pyspark.ml`` transformer or estimator whose columns keep their
roles. Override ``apply`` (and ``learn`` when something is fitted); both work
with column expressions and aggregates.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.meta import features_of, roles_of, with_roles


class _Cols(Params):
    cols = Param(Params._dummy(), "cols", "columns to work on; empty for all features", TypeConverters.toListString)

    def chosen(self, df: DataFrame) -> list[str]:
        named = self.getOrDefault(self.cols)
        return [c for c in (named or features_of(df)) if c in df.columns]


def keep_roles(before: DataFrame, after: DataFrame, new_role: str = "num") -> DataFrame:
    """Old columns keep their role; new ones without a role get ``new_role``."""
    known, named = roles_of(before), roles_of(after)
    roles = {}
    for c in after.columns:
        if c in named:
            roles[c] = named[c]
        elif c in known:
            roles[c] = known[c]
        elif c not in before.columns:
            roles[c] = new_role
    return with_roles(after, roles)


class ColumnStage(Transformer, _Cols):
    """A stage without fitted state."""

    @keyword_only
    def __init__(self, *, cols: list[str] | None = None):
        super().__init__()
        self._setDefault(cols=[])
        if cols is not None:
            self._set(cols=cols)

    def apply(self, df: DataFrame, cols: list[str]) -> DataFrame:
        raise NotImplementedError

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return keep_roles(dataset, self.apply(dataset, self.chosen(dataset)))


class FittedStage(Estimator, _Cols):
    """A stage that learns small state from the training table."""

    @keyword_only
    def __init__(self, *, cols: list[str] | None = None):
        super().__init__()
        self._setDefault(cols=[])
        if cols is not None:
            self._set(cols=cols)

    def learn(self, df: DataFrame, cols: list[str]) -> dict:
        raise NotImplementedError

    def apply(self, df: DataFrame, cols: list[str], state: dict) -> DataFrame:
        raise NotImplementedError

    def _fit(self, dataset: DataFrame) -> FittedStageModel:
        cols = self.chosen(dataset)
        return FittedStageModel(self, cols, self.learn(dataset, cols))


class FittedStageModel(Model):
    def __init__(self, stage: FittedStage, cols: list[str], state: dict):
        super().__init__()
        self.stage, self.cols, self.state = stage, cols, state

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return keep_roles(dataset, self.stage.apply(dataset, self.cols, self.state))


class ClipToRange(FittedStage):
    """A worked example: clamp numbers to train's range."""

    def learn(self, df: DataFrame, cols: list[str]) -> dict:
        row = df.agg(
            *[F.min(f"`{c}`").alias(f"l{i}") for i, c in enumerate(cols)],
            *[F.max(f"`{c}`").alias(f"h{i}") for i, c in enumerate(cols)],
        ).first()
        return {c: (row[f"l{i}"], row[f"h{i}"]) for i, c in enumerate(cols)}

    def apply(self, df: DataFrame, cols: list[str], state: dict) -> DataFrame:
        inside = lambda c: F.least(F.greatest(F.col(f"`{c}`"), F.lit(state[c][0])), F.lit(state[c][1]))
        return df.select(
            *[
                F.when(F.col(f"`{c}`").isNotNull(), inside(c)).alias(c, metadata=df.schema[c].metadata)
                if c in cols
                else F.col(f"`{c}`")
                for c in df.columns
            ]
        )

