"""Setting up a kit and turning it into a numeric training table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.joins import fitted
from tabloom.meta import Kit, Meta, as_role, columns_of, features_of, roles_of, with_roles
from tabloom.operators import columns as C
from tabloom.operators import encode as E
from tabloom.operators import impute as I
from tabloom.operators import models as M
from tabloom.operators import profile as P
from tabloom.operators.training import Task
from tabloom.session import stored, work_dir
from tabloom.sources.kits import drop_null_targets, rename_kit

# The default chain; ``columnwise`` stands for the per-column steps.
DEFAULT_CHAIN = ("drop_id", "drop_columns", "col_in_train_only", "columnwise", "rm_constant_col")
COLUMNWISE = ("text", "holidays", "date", "impute_cat", "impute_num", "encode_cat")
SELECTORS = ("variance_threshold", "select_kbest", "l1_selector", "rf_selector")
#: steps that only choose columns
CHOOSERS = ("rm_constant_col", *SELECTORS)


@dataclass
class ChainSettings:
    """Choices of the preparation chain; every one can be tuned per column."""

    category: dict[str, str] = field(default_factory=dict)
    date: dict[str, str] = field(default_factory=dict)
    text: dict[str, dict] = field(default_factory=dict)
    dropped: dict[str, bool] = field(default_factory=dict)
    imputer: str = "statistic"
    imputer_settings: dict = field(default_factory=dict)
    target_encoded: list[str] = field(default_factory=list)
    calendar: DataFrame | None = None
    store_input: bool = True
    chain: tuple[str, ...] = DEFAULT_CHAIN
    max_categories: int = E.MAX_CATEGORIES  # a column with more train values is hashed, whatever was chosen
    selectors: dict[str, dict] = field(default_factory=dict)  # parameters of the selectors named in ``chain``


def _kept(kit: Kit, *roles: str) -> list[str]:
    """Columns of a role present in both tables."""
    return [c for c in columns_of(kit.train, *roles) if c in kit.test.columns]


def _text(kit: Kit, s: ChainSettings) -> Kit:
    for c in _kept(kit, "text"):
        kit = E.encode_text_minhash(kit, c, **s.text.get(c, {}))
    return kit


def _holidays(kit: Kit, s: ChainSettings) -> Kit:
    """Only with exactly one date and one location column."""
    dates, places = _kept(kit, "date"), _kept(kit, "location")
    if s.calendar is None or len(dates) != 1 or len(places) != 1:
        return kit
    days = E.holiday_table(s.calendar, places[0])
    flag = lambda df: E.add_holidays(df, days, dates[0], places[0])
    return kit.replace(flag(kit.train), flag(kit.test))


def _date(kit: Kit, s: ChainSettings) -> Kit:
    for c in _kept(kit, "date"):
        kit = E.encode_date(kit, c, s.date.get(c, "cyclical"))
    return kit


def _impute(kit: Kit, s: ChainSettings, role: str) -> Kit:
    """Only columns with gaps are fitted."""
    num, cat = _kept(kit, "num"), _kept(kit, "cat")
    cols = cat if role == "cat" else num
    if not cols:
        return kit
    counts = P.missing_counts(kit.train, kit.test, cols).collect()  # one row per column
    gaps = {r["feature"]: r["missing"] for r in counts}
    gappy = [c for c in cols if gaps.get(c)]
    if s.imputer == "statistic":
        return I.impute_mode(kit, gappy) if role == "cat" else I.impute_median(kit, gappy)
    return I.impute_models(kit, gappy, num, cat, **s.imputer_settings)


def _encode_cat(kit: Kit, s: ChainSettings) -> Kit:
    """Categories, locations and binary columns that hold text."""
    y = F.col(kit.meta.target_cols[0]).cast("double")
    flagged = [c for c in s.target_encoded if c in kit.train.columns]
    if flagged:
        kit = E.add_target_encoding(kit, flagged, y)
    types = dict(kit.train.dtypes)
    cats = _kept(kit, "cat", "location") + [c for c in _kept(kit, "bin") if types[c] == "string"]
    spelled = [c for c in cats if s.category.get(c, "onehot") == "onehot"]
    values = E.category_values(kit, cats, s.max_categories, spelled)
    for c in cats:
        kit = E.encode_category(kit, c, s.category.get(c, "onehot"), y, values)
    return kit


def _select(kit: Kit, name: str, s: ChainSettings) -> Kit:
    """Numeric features that a selector keeps; it is fitted on complete training rows."""
    cols, p = numeric_features(kit), dict(s.selectors.get(name, {}))
    if not cols:
        return kit
    target, classes = kit.meta.target_cols[0], 0
    if kit.meta.is_classification:
        classes = len(kit.meta.target_values.get(target, [])) or 2
    if name == "variance_threshold":
        kept = C.variance_threshold(kit.train, cols, **p)
    elif name == "select_kbest":
        best = C.select_kbest(kit.train, cols, target, bool(classes), **p)
        kept = [r["feature"] for r in best.select("feature").collect()]  # a row per feature
    elif not classes:
        raise ValueError(f"{name} needs a classification target")
    elif name == "l1_selector":
        kept = M.l1_selector(kit.train, cols, target, classes=classes, **p)
    else:
        kept = M.rf_selector(kit.train, cols, target, **p)
    return C.keep_features(kit, cols, kept or cols[:1])


def steps(s: ChainSettings) -> list[str]:
    """The chain's steps in order, ``columnwise`` written out."""
    return [name for entry in s.chain for name in (COLUMNWISE if entry == "columnwise" else (entry,))]


def step(kit: Kit, name: str, s: ChainSettings) -> Kit:
    keep = [kit.meta.id_col, *kit.meta.target_cols]
    if name == "drop_id":
        return kit  # the id keeps its key role and is not a feature
    if name == "drop_columns":
        return kit.replace(C.drop_columns(kit.train, s.dropped), C.drop_columns(kit.test, s.dropped))
    if name == "col_in_train_only":
        return kit.replace(*C.col_in_train_only(kit.train, kit.test, keep))
    if name == "rm_constant_col":
        return kit.replace(*C.rm_constant_col(kit.train, kit.test, features_of(kit.train)))
    if name in SELECTORS:
        return _select(kit, name, s)
    if name == "text":
        return _text(kit, s)
    if name == "holidays":
        return _holidays(kit, s)
    if name == "date":
        return _date(kit, s)
    if name == "impute_cat":
        return _impute(kit, s, "cat")
    if name == "impute_num":
        return _impute(kit, s, "num")
    if name == "encode_cat":
        return _encode_cat(kit, s)
    raise ValueError(f"unknown preparation step {name}")


def stored_kit(kit: Kit) -> Kit:
    return kit.replace(stored(kit.train, "train"), stored(kit.test, "test"))


def preprocess_chain(kit: Kit, settings: ChainSettings | None = None) -> Kit:
    """Run the ordered list of steps; the resulting features are numbers.

    The fitting steps pass over the tables several times, so unless they are
    plain scans already (``store_input`` off) they are stored once before. The
    steps that choose columns read all of them: what was made so far is stored
    before the first of these, and their choice is a projection of that file.
    """
    s = settings or ChainSettings()
    if s.store_input:
        kit = stored_kit(kit)
    made = False
    for name in steps(s):
        if name in CHOOSERS and made:
            kit, made = stored_kit(kit), False
        kit, before = step(kit, name, s), kit
        made = made or (name in COLUMNWISE and (kit.train is not before.train or kit.test is not before.test))
    return kit


def numeric_features(kit: Kit) -> list[str]:
    roles = roles_of(kit.train)
    return [c for c in features_of(kit.train) if roles[c] in ("num", "bin") and c in kit.test.columns]


def clean_kit(kit: Kit) -> Kit:
    """Rows without a target go, names become plain, categories are cleaned."""
    kit = Kit(drop_null_targets(kit.train, kit.meta.target_cols), kit.test, kit.meta, kit.sample)
    kit = rename_kit(kit)
    cats = [c for c, r in kit.meta.roles.items() if r in ("cat", "bin")]
    clean = lambda df: P.clean_categories(df, [c for c in cats if c in df.columns])
    return kit.replace(clean(kit.train), clean(kit.test))


LISTED_VALUES = 300


def profile_kit(kit: Kit) -> Kit:
    """Add missing and unique counts and category values to the description.

    All values of categorical and binary columns are kept as a table, whose
    path is in the profile. Columns with at most ``LISTED_VALUES`` values over
    both tables have them listed in the profile as well.
    """
    roles = {c: r for c, r in kit.meta.roles.items() if c != kit.meta.id_col}
    cols = [c for c in roles if c in kit.train.columns or c in kit.test.columns]
    missing = P.missing_counts(kit.train, kit.test, cols).collect()
    counted = [c for c in cols if roles[c] in ("num", "cat") and c in kit.train.columns]
    unique = P.unique_counts(kit.train, counted).collect() if counted else []
    cats = [c for c in cols if roles[c] in ("cat", "bin") and c in kit.train.columns and c in kit.test.columns]
    values: dict[str, list[str]] = {}
    path = None
    if cats:
        path = work_dir(kit.train.sparkSession, "feature_values")
        P.feature_values(kit.train, kit.test, cats).write.parquet(path)
        table = kit.train.sparkSession.read.parquet(path)
        sizes = table.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()  # a row per column
        listed = [r["feature"] for r in sizes if r["n"] <= LISTED_VALUES]
        for r in table.where(F.col("feature").isin(listed)).orderBy("feature", "value").collect():
            values.setdefault(r["feature"], []).append(r["value"])
    m = kit.meta
    profile = {
        "missing_data_count": {r["feature"]: r["missing"] for r in missing},
        "unique_value_count": {r["feature"]: r["n_unique"] for r in unique},
        "feature_values": values,
        "feature_values_table": path,
    }
    meta = Meta(
        m.title, m.id_col, m.target_cols, m.prediction_type, m.score_name, m.roles, m.casts,
        m.positive_values, m.target_values, profile,
    )
    return Kit(kit.train, kit.test, meta, kit.sample)


def code_targets(kit: Kit) -> Kit:
    """Integer class codes, and stand-in targets for a test table without any."""
    train, test, meta = kit.train, kit.test, kit.meta
    values = dict(meta.target_values)
    for t in meta.target_cols:
        if meta.is_classification:
            codes = fitted(P.label_codes(train, t, meta.id_col))
            values[t] = [str(r[t]) for r in codes.table.orderBy("code").collect()]  # one row per class
            train = P.encode_labels(train, codes, t)
            if t in test.columns:
                test = P.encode_labels(test, codes, t)
        test = P.dummy_targets(train, test, t, meta.id_col, meta.is_classification)
    role = {t: "target" for t in meta.target_cols}
    new = Meta(
        meta.title, meta.id_col, meta.target_cols, meta.prediction_type, meta.score_name, meta.roles,
        meta.casts, meta.positive_values, values, meta.profile,
    )
    return Kit(with_roles(train, role), with_roles(test, role), new, kit.sample)


def setup(kit: Kit) -> Kit:
    """Read kit to clean, profiled kit with coded targets."""
    return code_targets(profile_kit(stored_kit(clean_kit(kit))))


def make_task(kit: Kit, target: str | None = None, write: bool = True) -> Task:
    """A prepared kit as a training task; tables are written once, then read per fold.

    Without ``write`` they are projections of the kit's tables, for a kit that
    lies in files already.
    """
    t = target or kit.meta.target_cols[0]
    # a regression of several targets holds them all, unless one is asked for
    several = () if target or kit.meta.is_classification or len(kit.meta.target_cols) < 2 else tuple(kit.meta.target_cols)
    cols = numeric_features(kit)

    def shape(df: DataFrame, have: bool) -> DataFrame:
        out = df.select(
            kit.meta.id_col, *([F.col(c).cast("double").alias(c) for c in several or (t,)] if have else []),
            *[as_role(F.col(f"`{c}`").cast("double"), c) for c in cols],
        )
        return stored(out, "task") if write else out

    classes = len(kit.meta.target_values.get(t, [])) if kit.meta.is_classification else 0
    return Task(shape(kit.train, True), shape(kit.test, t in kit.test.columns), kit.meta.id_col, t, cols, kit.meta.score_name, classes, several)
