"""Problem description and column roles.

A column's role (``num``, ``cat``, ``bin``, ``text``, ``date``, ``location``,
``id``, ``target``) is stored in its field metadata, so it follows the column
through every transformation.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURE_ROLES = ("num", "cat", "bin", "text", "date", "location")


@dataclass
class Meta:
    """What a kit's ``metadata.json`` declares, plus the profile added by setup."""

    title: str
    id_col: str
    target_cols: list[str]
    prediction_type: str
    score_name: str
    roles: dict[str, str]
    casts: dict[str, str] = field(default_factory=dict)
    positive_values: dict[str, str] = field(default_factory=dict)
    target_values: dict[str, list[str]] = field(default_factory=dict)
    profile: dict = field(default_factory=dict)

    @property
    def is_classification(self) -> bool:
        return "classification" in self.prediction_type

    @classmethod
    def from_json(cls, text: str) -> Meta:
        raw = json.loads(text)
        desc = raw["data_description"]
        return cls(
            title=raw.get("title", ""),
            id_col=raw["id_col"],
            target_cols=list(desc["target_cols"]),
            prediction_type=raw["prediction_type"],
            score_name=raw["score_name"],
            roles=dict(desc["feature_types"]),
            casts=dict(desc.get("feature_types_to_cast") or {}),
            positive_values=dict(desc.get("positive_target_values") or {}),
            target_values=dict(desc.get("target_values") or {}),
            profile={
                k: desc[k]
                for k in ("feature_values", "missing_data_count", "unique_value_count")
                if k in desc
            },
        )

    def to_json(self) -> str:
        d = asdict(self)
        desc = {
            "target_cols": d["target_cols"],
            "feature_types": d["roles"],
            "feature_types_to_cast": d["casts"] or None,
            "positive_target_values": d["positive_values"],
            "target_values": d["target_values"],
            **d["profile"],
        }
        return json.dumps(
            {
                "title": d["title"],
                "id_col": d["id_col"],
                "prediction_type": d["prediction_type"],
                "score_name": d["score_name"],
                "data_description": desc,
            },
            indent=2,
            sort_keys=True,
        )


@dataclass
class Kit:
    """A train table, a test table, their description and an optional sample output."""

    train: DataFrame
    test: DataFrame
    meta: Meta
    sample: DataFrame | None = None

    def replace(self, train: DataFrame, test: DataFrame) -> Kit:
        return Kit(train, test, self.meta, self.sample)

    def both(self) -> DataFrame:
        """Train and test rows over the columns they share."""
        shared = [c for c in self.train.columns if c in self.test.columns]
        return self.train.select(*shared).unionByName(self.test.select(*shared))


def as_role(expr: Column, name: str, role: str = "num") -> Column:
    return expr.alias(name, metadata={"role": role})


def with_roles(df: DataFrame, roles: dict[str, str]) -> DataFrame:
    return df.select(
        *[as_role(F.col(f"`{c}`"), c, roles[c]) if c in roles else F.col(f"`{c}`") for c in df.columns]
    )


def roles_of(df: DataFrame) -> dict[str, str]:
    return {f.name: f.metadata["role"] for f in df.schema.fields if "role" in f.metadata}


def columns_of(df: DataFrame, *wanted: str) -> list[str]:
    """Columns holding one of the roles, in table order."""
    return [c for c, r in roles_of(df).items() if r in wanted]


def features_of(df: DataFrame) -> list[str]:
    return columns_of(df, *FEATURE_ROLES)
