"""Prepared tables that a race can tune: each fitted step is kept and found again.

A step's key is the hash of its name, of the settings it reads and of the key
of its input; the first key is a digest of the kit's rows. Steps that change
values are written below their key, once; steps that choose columns keep the
list of what they drop; plain projections keep nothing. Moving one setting thus
refits only the steps behind it.

The table ``prepared`` is a row per finished step, appended after its files are
whole, so that a step broken off is made anew.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.meta import Kit, columns_of
from tabloom.operators.space import Dim, drop_column_dims
from tabloom.operators.training import Store, Task
from tabloom.plans import prepare as R

STEPS = "key string, step string, kind string, dropped array<string>"
PROJECTIONS = ("drop_id", "drop_columns", "col_in_train_only")
ENCODERS = ("onehot", "count", "binary", "target", "hashing")
DATE_ENCODERS = ("cyclical", "cyclical_ohe", "raw")


def digest(*parts: object) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:20]


def table_digest(df: DataFrame) -> list:
    """Names, types and a sum of row hashes: one pass, whatever the order of rows."""
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(2**31))).alias("h"),
    ).first()
    return [df.dtypes, row["n"], row["h"]]


def preparation_dims(kit: Kit, priors: dict[str, float] | None = None, steps: tuple[str, ...] = ("drop_columns", "encode_cat", "date", "impute")) -> list[Dim]:
    """What can be tuned in the preparation of a kit that was set up, an element per step.

    A drop flag for each feature (with its drop probability from ``priors``), an
    encoder for each category and location, one for each date, and the imputer.
    """
    both = [c for c in kit.train.columns if c in kit.test.columns]
    features = [c for c in columns_of(kit.train, "num", "bin", "cat", "text", "date", "location") if c in both]
    dims: list[Dim] = []
    if "drop_columns" in steps:
        dims += drop_column_dims([(c, (priors or {}).get(c)) for c in features])
    if "encode_cat" in steps:
        dims += [Dim(f"{c}_encoder", ENCODERS, "onehot", (), "encode_cat") for c in columns_of(kit.train, "cat", "location") if c in both]
    if "date" in steps:
        dims += [Dim(f"{c}_parts", DATE_ENCODERS, "cyclical", (), "date") for c in columns_of(kit.train, "date") if c in both]
    if "impute" in steps:
        dims.append(Dim("imputer", ("statistic", "model"), "statistic", (), "impute"))
    return dims


def chain_settings(values: dict[str, object], base: R.ChainSettings) -> R.ChainSettings:
    """The chain that the values of ``preparation_dims`` ask for; other values are not read."""
    part = lambda tail: {n[: -len(tail)]: v for n, v in values.items() if n.endswith(tail)}
    return replace(
        base,
        dropped={**base.dropped, **part("_to_drop")},
        category={**base.category, **part("_encoder")},
        date={**base.date, **part("_parts")},
        imputer=str(values.get("imputer", base.imputer)),
    )


def _reads(name: str, s: R.ChainSettings) -> object:
    """The settings that a step reads."""
    if name == "drop_columns":
        return sorted(c for c, on in s.dropped.items() if on)
    if name in R.SELECTORS:
        return s.selectors.get(name, {})
    return {
        "text": s.text,
        "holidays": s.calendar is not None,
        "date": s.date,
        "impute_cat": [s.imputer, s.imputer_settings],
        "impute_num": [s.imputer, s.imputer_settings],
        "encode_cat": [s.category, s.target_encoded, s.max_categories],
    }.get(name)


@dataclass
class Preparation:
    """Prepared forms of one set-up kit, below ``store``."""

    kit: Kit
    store: Store
    base: R.ChainSettings = field(default_factory=R.ChainSettings)
    done: dict[str, tuple[str, list[str]]] = field(default_factory=dict)  # finished steps by key
    fitted: list[str] = field(default_factory=list)  # steps that this object had to fit, in order

    def __post_init__(self) -> None:
        k = self.kit
        self.input_key = digest(table_digest(k.train), table_digest(k.test), k.meta.to_json())
        for r in self.store.read("prepared", STEPS).collect():  # a row per step and setting tried
            self.done[r["key"]] = (r["kind"], list(r["dropped"]))

    def _path(self, key: str, part: str) -> str:
        return f"{self.store.path}/prepared_tables/{key}/{part}"

    def _finish(self, key: str, name: str, kind: str, dropped: list[str]) -> None:
        self.store.append([(key, name, kind, dropped)], "prepared", STEPS)
        self.done[key] = (kind, dropped)
        self.fitted.append(name)

    def _fit(self, key: str, name: str, kit: Kit, s: R.ChainSettings) -> None:
        out = R.step(kit, name, s)
        if name in R.CHOOSERS:
            self._finish(key, name, "chooses", [c for c in kit.train.columns if c not in out.train.columns])
        elif out.train is kit.train and out.test is kit.test:
            self._finish(key, name, "same", [])
        else:
            for part, df in (("train", out.train), ("test", out.test)):
                df.write.mode("overwrite").parquet(self._path(key, part))
            self._finish(key, name, "written", [])

    def prepared(self, settings: R.ChainSettings) -> tuple[str, Kit]:
        """(key, kit) after the whole chain; what was fitted before is read."""
        key, kit, spark = self.input_key, self.kit, self.store.spark
        for name in R.steps(settings):
            key = digest(key, name, _reads(name, settings))
            if name in PROJECTIONS:
                kit = R.step(kit, name, settings)
                continue
            if key not in self.done:
                self._fit(key, name, kit, settings)
            kind, dropped = self.done[key]
            if kind == "chooses":
                kit = kit.replace(kit.train.drop(*dropped), kit.test.drop(*dropped))
            elif kind == "written":
                kit = kit.replace(*[spark.read.parquet(self._path(key, part)) for part in ("train", "test")])
        return key, kit

    def task(self, values: dict[str, object], target: str | None = None) -> tuple[str, Task]:
        """(key, training task) for the values of a trial."""
        key, kit = self.prepared(chain_settings(values, self.base))
        return key, R.make_task(kit, target, write=False)
