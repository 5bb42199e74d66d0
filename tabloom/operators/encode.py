"""Category, text and date encoders; holiday flags."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.hashing import md5_mod
from tabloom.functions.joins import Fitted, attach, fitted
from tabloom.functions.names import category_name, safe_name, unique_names
from tabloom.functions.running import running
from tabloom.meta import Kit, as_role
from tabloom.operators.columns import constant_over
from tabloom.operators.profile import unique_counts, value_counts
from tabloom.session import settle, stored

# Limits of the category encoders.
MAX_CATEGORIES = 20
HASH_COLUMNS = 20
MAX_TARGET_CATEGORIES = 300
SMOOTHING = 10.0
MIN_LEAF = 1


def _values(df: DataFrame, col: str) -> list:
    """Distinct values, null first: each gets a column, so the caller bounds them."""
    found = [r["v"] for r in df.select(F.col(f"`{col}`").alias("v")).distinct().collect()]
    return ([None] if None in found else []) + sorted(v for v in found if v is not None)


def _swap(df: DataFrame, col: str, new: list[Column]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != col], *new)


def _on_both(kit: Kit, col: str, new: list[Column]) -> Kit:
    return kit.replace(_swap(kit.train, col, new), _swap(kit.test, col, new))


def category_values(
    kit: Kit, cols: list[str], limit: int = MAX_CATEGORIES, spelled: list[str] | None = None
) -> dict[str, list | None]:
    """Values over both tables of the columns with at most ``limit`` train values.

    One pass over the rows serves all columns. Wider columns map to None,
    however many values the test table has. Only the columns ``spelled`` (all
    by default) have their values listed; other narrow ones map to an empty list.
    """
    if not cols:
        return {}
    side = lambda df, n: value_counts(df, cols).withColumn("_train", F.lit(n))
    seen = settle(
        side(kit.train, 1).unionByName(side(kit.test, 0)).groupBy("feature", "value").agg(F.max("_train").alias("_train"))
    )
    sizes = seen.groupBy("feature").agg(F.sum("_train").alias("t")).collect()  # a row per column
    few = [r["feature"] for r in sizes if r["t"] <= limit]
    out: dict[str, list | None] = {c: None for c in cols}
    out |= {c: [] for c in few}
    listed = few if spelled is None else [c for c in few if c in spelled]
    for r in seen.where(F.col("feature").isin(listed)).orderBy("feature", F.col("value").asc_nulls_first()).collect():
        out[r["feature"]].append(r["value"])
    return out


def encode_onehot(kit: Kit, col: str, values: list | None = None) -> Kit:
    """0/1 columns per category over train and test; null is a category.

    Of exactly two categories only the second gets a column. ``values`` saves
    a pass when the categories are known.
    """
    values = _values(kit.both(), col) if values is None else values
    if len(values) == 2:
        values = values[1:]
    names = unique_names([category_name(col, v) for v in values])
    src = F.col(f"`{col}`")
    new = [
        as_role((src.isNull() if v is None else src.eqNullSafe(F.lit(v))).cast("int"), n)
        for v, n in zip(values, names)
    ]
    return _on_both(kit, col, new)


def category_counts(df: DataFrame, col: str, out: str = "n") -> DataFrame:
    return df.groupBy(F.col(f"`{col}`").alias(col)).agg(F.count(F.lit(1)).alias(out))


def encode_count(kit: Kit, col: str) -> Kit:
    """The category's row count over train and test; unseen and null give their own."""
    counts = settle(category_counts(kit.both(), col, "_n"))
    null_row = counts.where(F.col(f"`{col}`").isNull()).first()
    nulls = null_row["_n"] if null_row else 0
    known = fitted(counts.where(F.col(f"`{col}`").isNotNull()))

    def apply(df: DataFrame) -> DataFrame:
        hit = attach(df, known, [col], weight="_n")
        n = F.when(F.col(f"`{col}`").isNull(), F.lit(nulls)).otherwise(F.coalesce("_n", F.lit(0)))
        return _swap(hit.withColumn("_m", n.cast("long")), col, []).select(
            *[c for c in df.columns if c != col], as_role(F.col("_m"), col)
        )

    return kit.replace(apply(kit.train), apply(kit.test))


def target_means(
    train: DataFrame, col: str, y: Column, smoothing: float = SMOOTHING, min_leaf: int = MIN_LEAF
) -> tuple[DataFrame, float]:
    """``(category, code, n)`` with the smoothed mean of ``y``, and the prior."""
    prior = train.agg(F.avg(y)).first()[0]
    if prior is None:
        raise ValueError("target encoding needs a non-empty target")
    per = (
        train.where(F.col(f"`{col}`").isNotNull())
        .groupBy(F.col(f"`{col}`").alias(col))
        .agg(F.avg(y).alias("_mean"), F.count(F.lit(1)).alias("_n"))
    )
    w = F.lit(1.0) / (1 + F.exp(-(F.col("_n") - min_leaf) / F.lit(float(smoothing))))
    code = F.lit(float(prior)) * (1 - w) + F.col("_mean") * w
    return per.select(col, code.alias("_code"), "_n"), float(prior)


def _with_code(df: DataFrame, codes: Fitted, prior: float, col: str, out: str) -> DataFrame:
    keep = df.columns
    hit = attach(df, codes, [col], weight="_n")
    return hit.select(*keep, as_role(F.coalesce("_code", F.lit(prior)), out))


def encode_target(kit: Kit, col: str, y: Column, **settings) -> Kit:
    """Replace the category by train's smoothed target mean; unseen gets the prior."""
    codes, prior = target_means(kit.train, col, y, **settings)
    codes = fitted(codes)

    def apply(df: DataFrame) -> DataFrame:
        coded = _with_code(df, codes, prior, col, "_enc")
        return coded.select(*[c for c in df.columns if c != col], as_role(F.col("_enc"), col))

    return kit.replace(apply(kit.train), apply(kit.test))


def encode_target_out_of_fold(train: DataFrame, col: str, y: str, fold: str, smoothing: float = SMOOTHING) -> DataFrame:
    """Target means that leave out the row's own fold, so no row sees its target.

    Category totals minus the category's totals in the fold; both tables have
    at most categories x folds rows. A missing category, and one that no other
    fold has, get the prior of the other folds.
    """
    part = train.groupBy(col, fold).agg(F.sum(y).alias("_s"), F.count(y).alias("_n"))
    base = fitted(part.groupBy(fold).agg(F.sum("_s").alias("_sf"), F.sum("_n").alias("_nf")))
    tot = base.table.agg(F.sum("_sf").alias("s"), F.sum("_nf").alias("n")).first()
    if not tot["n"]:
        raise ValueError("target encoding needs a non-empty target")
    known = part.where(F.col(f"`{col}`").isNotNull())
    whole = known.groupBy(col).agg(F.sum("_s").alias("_st"), F.sum("_n").alias("_nt"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    mean_of_all = F.lit(float(tot["s"]) / tot["n"])
    prior = F.coalesce(F.try_divide(F.lit(float(tot["s"])) - zero("_sf"), F.lit(tot["n"]) - F.col("_nf")), mean_of_all)
    n = zero("_nt") - zero("_n")
    w = F.lit(1.0) / (1 + F.exp(-(n - MIN_LEAF) / F.lit(float(smoothing))))
    mean = F.try_divide(zero("_st") - zero("_s"), n)
    code = F.when(mean.isNull(), prior).otherwise(prior * (1 - w) + mean * w)
    table = known.join(whole, col).select(col, fold, "_n", "_s", "_nt", "_st")
    hit = attach(attach(train, table, [col, fold], weight="_n"), base, [fold])
    return hit.select(*train.columns, as_role(code, f"{col}_target_encode"))


def target_encode_columns(kit: Kit, cols: list[str], limit: int = MAX_TARGET_CATEGORIES) -> list[str]:
    """The columns with fewer distinct train values than ``limit``."""
    sizes = {r["feature"]: r["n_unique"] for r in unique_counts(kit.train, cols).collect()}  # a row per column
    return [c for c in cols if sizes[c] < limit]


def add_target_encoding(kit: Kit, cols: list[str], y: Column, **settings) -> Kit:
    """Append ``<col>_target_encode`` for flagged columns with few values."""
    train, test = kit.train, kit.test
    for c in target_encode_columns(kit, cols):
        codes, prior = target_means(kit.train, c, y, **settings)
        codes = fitted(codes)
        train = _with_code(train, codes, prior, c, f"{c}_target_encode")
        test = _with_code(test, codes, prior, c, f"{c}_target_encode")
    return kit.replace(train, test)


def encode_binary(kit: Kit, col: str) -> Kit:
    """Ordinal code of the sorted values from 1, as bit columns; unknown is 0.

    The codes are a table, so any number of values will do: the rank of a value
    is a running count over the distinct values.
    """
    src = F.col(f"`{col}`")
    values = kit.both().select(src.alias(col)).distinct().withColumn("_one", F.lit(1))
    values = stored(values.withColumn("_all", F.lit(0)), "values")
    order = [src.asc_nulls_first()]
    codes = fitted(running(values, ["_all"], order, {"_code": ("sum", "_one")}).select(col, "_code"))
    width = max(1, math.ceil(math.log2(codes.rows + 1)))
    null_code = codes.table.where(src.isNull()).first()
    of_null = F.lit(null_code["_code"] if null_code else 0)
    code = F.when(src.isNull(), of_null).otherwise(F.coalesce("_code", F.lit(0))).cast("long")
    new = [
        as_role(F.getbit(code, F.lit(width - 1 - i)).cast("int"), f"{safe_name(col)}_{i}") for i in range(width)
    ]

    def apply(df: DataFrame) -> DataFrame:
        return _swap(attach(df, codes, [col]), col, new).drop("_code")

    return kit.replace(apply(kit.train), apply(kit.test))


def encode_hashing(kit: Kit, col: str, n: int = HASH_COLUMNS, drop_constant: bool = True) -> Kit:
    """Category hashed to one of ``n`` indicator columns; constant ones go.

    The bucket is computed in a projection of its own, once per row.
    """
    bucket = md5_mod(n, F.coalesce(F.col(f"`{col}`").cast("string"), F.lit("nan")))
    hit = set(range(n))
    if drop_constant:
        values = kit.both().select(F.col(f"`{col}`")).distinct()
        hit = {r["b"] for r in values.select(bucket.alias("b")).distinct().collect()}  # at most n rows
        hit = hit if len(hit) > 1 else set()
    new = [as_role((F.col("_bucket") == i).cast("int"), f"{safe_name(col)}_col_{i}") for i in sorted(hit)]

    def apply(df: DataFrame) -> DataFrame:
        keep = [F.col(f"`{c}`") for c in df.columns if c != col]
        return df.withColumn("_bucket", bucket).select(*keep, *new)

    return kit.replace(apply(kit.train), apply(kit.test))


def encode_category(
    kit: Kit, col: str, strategy: str = "onehot", y: Column | None = None, values: dict | None = None,
    limit: int = MAX_CATEGORIES,
) -> Kit:
    """The chosen encoder; columns with more than ``limit`` train values are hashed.

    ``values`` is the result of ``category_values`` for all columns.
    """
    found = (values or category_values(kit, [col], limit))[col]
    if found is None:
        return encode_hashing(kit, col)
    if strategy == "target":
        return encode_target(kit, col, y)
    if strategy.startswith("hashing"):
        n = int(strategy.split("_")[1]) if "_" in strategy else HASH_COLUMNS
        return encode_hashing(kit, col, n)
    if strategy == "onehot":
        return encode_onehot(kit, col, found)
    return {"count": encode_count, "binary": encode_binary}[strategy](kit, col)


# --- text ------------------------------------------------------------------

# Odd multipliers of the gram hash and of the hash family.
GRAM_BASE = 0x9E3779B97F4A7C15
FAMILY_STEP = 0xD1342543DE82EF95
CHUNK = 1 << 12
BATCH_CHARS = 1 << 18
_WORD = 2**64


def hash_family(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and offsets of ``n`` linear hashes over 64-bit words."""
    a, b, x = [], [], 1
    for _ in range(n):
        x = (x * FAMILY_STEP + 12345) % _WORD
        a.append(x | 1)
        x = (x * FAMILY_STEP + 12345) % _WORD
        b.append(x)
    return np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64)


def gram_hashes(text: str, lo: int, hi: int) -> list[np.ndarray]:
    """Per length ``lo`` to ``hi``, the hashes of all character n-grams.

    A gram's hash extends the hash of the gram one character shorter, so each
    length costs one pass over the text. Arithmetic wraps at 64 bits.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    base, out = np.uint64(GRAM_BASE), []
    h = np.zeros(len(codes) + 1, dtype=np.uint64)
    for n in range(1, hi + 1):
        if len(codes) < n:
            break
        h = (h[:-1] + codes[n - 1 :] + np.uint64(1)) * base
        h ^= h >> np.uint64(29)
        if n >= lo:
            out.append(h)
    return out


def minhash(text: str, n: int, lo: int, hi: int, minmax: bool) -> list[float]:
    """The hash signature of one whole text, scaled to [0, 1); zeros without grams.

    With ``minmax`` the first half holds minima and the second half maxima of
    the same hashes. Grams are hashed in chunks, all hashes of a chunk at once,
    so memory does not grow with the text times ``n``.
    """
    mins = (n + 1) // 2 if minmax else n
    a, b = hash_family(mins)
    low = np.full(mins, _WORD - 1, dtype=np.uint64)
    high = np.zeros(mins, dtype=np.uint64)
    lengths = gram_hashes(text, lo, hi)
    if not lengths:
        return [0.0] * n
    grams = np.concatenate(lengths)
    buffer = np.empty((mins, min(CHUNK, len(grams))), dtype=np.uint64)
    for i in range(0, len(grams), CHUNK):
        part = grams[i : i + CHUNK]
        h = buffer[:, : len(part)]
        np.multiply(a[:, None], part[None, :], out=h)
        h += b[:, None]
        np.minimum(low, h.min(axis=1), out=low)
        if minmax:
            np.maximum(high, h.max(axis=1), out=high)
    words = np.concatenate([low, high[: n - mins]]) if minmax else low
    return ((words >> np.uint64(11)).astype(np.float64) / 2.0**53).tolist()


def minhash_batch(texts: list[str], n: int, lo: int, hi: int, minmax: bool) -> np.ndarray:
    """Signatures of many texts at once: a row of ``n`` numbers each.

    Short texts are joined, hashed together and reduced by their offsets; a
    long one is hashed alone in chunks, so memory stays bounded.
    """
    out = np.zeros((len(texts), n))
    mins = (n + 1) // 2 if minmax else n
    a, b = hash_family(mins)
    short: list[int] = []
    size = 0

    def flush() -> None:
        grams = [np.concatenate(g) if (g := gram_hashes(texts[i], lo, hi)) else np.zeros(0, np.uint64) for i in short]
        counts = np.array([len(g) for g in grams])
        has = np.flatnonzero(counts)
        if len(has):
            flat = np.concatenate([grams[k] for k in has])
            starts = np.concatenate([[0], np.cumsum(counts[has])[:-1]])
            rows = np.array(short)[has]
            for j in range(mins):
                h = flat * a[j] + b[j]
                out[rows, j] = (np.minimum.reduceat(h, starts) >> np.uint64(11)).astype(np.float64) / 2.0**53
                if minmax and mins + j < n:
                    out[rows, mins + j] = (np.maximum.reduceat(h, starts) >> np.uint64(11)).astype(np.float64) / 2.0**53

    for i, t in enumerate(texts):
        if len(t) > BATCH_CHARS:
            out[i] = minhash(t, n, lo, hi, minmax)
            continue
        if size + len(t) > BATCH_CHARS:
            flush()
            short, size = [], 0
        short.append(i)
        size += len(t)
    flush()
    return out


def text_signature(col: Column, n: int = 30, grams: str = "2-4", minmax: bool = False) -> Column:
    """Array of ``n`` minimum hashes over the whole text's character n-grams.

    A Pandas UDF: higher-order SQL functions would build an array of hundreds
    of thousands of strings per long document and interpret a lambda for each
    gram and hash. Rows stay where they are; there is no shuffle.
    """
    lo, hi = (int(v) for v in grams.split("-"))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def sign(texts: pd.Series) -> pd.Series:
        return pd.Series(list(minhash_batch(texts.tolist(), n, lo, hi, minmax)))

    return sign(F.coalesce(col.cast("string"), F.lit("nan")))


def encode_text_minhash(kit: Kit, col: str, n: int = 30, grams: str = "2-4", minmax: bool = False) -> Kit:
    """Replace a text column by ``n`` numeric columns.

    Hashing is the heavy part, so a table in fewer partitions than cores is
    spread first; one with more stays where it is. Either way the rows are the
    same.
    """

    def apply(df: DataFrame) -> DataFrame:
        cores = df.sparkSession.sparkContext.defaultParallelism
        spread = df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
        signed = spread.withColumn("_sig", text_signature(F.col(f"`{col}`"), n, grams, minmax))
        new = [as_role(F.col("_sig")[i], f"{safe_name(col)}_{i}") for i in range(n)]
        return signed.select(*[F.col(f"`{c}`") for c in df.columns if c != col], *new)

    return kit.replace(apply(kit.train), apply(kit.test))


# --- dates -----------------------------------------------------------------

# Period of every cyclical date part.
PERIODS = {
    "month": 12.0,
    "weekofyear": 52.0,
    "dayofyear": 365.25,
    "dayofmonth": 30.0,
    "dayofweek": 7.0,
    "hour": 24.0,
    "minute": 60.0,
    "second": 60.0,
    "microsecond": 1e6,
    "nanosecond": 1e9,
}
ONEHOT_PARTS = {"month": range(1, 13), "dayofweek": range(0, 7), "hour": range(0, 24)}


def date_parts(c: Column) -> dict[str, Column]:
    """Integer parts; weekday counts from Monday = 0, nanosecond is below a micro."""
    ts = c.cast("timestamp")
    return {
        "month": F.month(c),
        "weekofyear": F.weekofyear(c),
        "dayofyear": F.dayofyear(c),
        "dayofmonth": F.dayofmonth(c),
        "dayofweek": F.weekday(c),
        "hour": F.hour(ts),
        "minute": F.minute(ts),
        "second": F.second(ts),
        "microsecond": F.pmod(F.unix_micros(ts), F.lit(1_000_000)).cast("int"),
        "nanosecond": F.when(c.isNotNull(), F.lit(0)),
    }


def date_columns(col: str, strategy: str = "cyclical") -> dict[str, Column]:
    """Named expressions over the parts ``_<part>`` of the strategy.

    Strategies are ``raw``, ``cyclical`` and ``cyclical-ohe``.
    """
    out = {f"{col}_year": F.col("_year")}
    if strategy == "raw":
        return out | {f"{col}_{p}": F.col(f"_{p}") for p in PERIODS}
    if strategy not in ("cyclical", "cyclical-ohe"):
        raise ValueError(f"unknown date encoding {strategy}")
    for p, period in PERIODS.items():
        if strategy == "cyclical" or p not in ONEHOT_PARTS:
            for fn in ("cos", "sin"):
                out[f"{col}_{p}_{fn}"] = F.expr(f"{fn}(_{p} / {period!r}D * 2 * {math.pi!r}D)")
    if strategy == "cyclical-ohe":
        for p, values in ONEHOT_PARTS.items():
            for v in values:
                out[f"{col}_{p}_{v}"] = F.expr(f"cast(_{p} = {v} as int)")
    return out


def encode_date(kit: Kit, col: str, strategy: str = "cyclical", drop_constant: bool = True) -> Kit:
    """Replace a date column by its parts, then drop the constant ones.

    Parts are taken once in a projection of their own; waves and indicators
    build on them.
    """
    src = F.col(f"`{col}`")
    exprs = date_columns(col, strategy)
    new = [as_role(e, n) for n, e in exprs.items()]

    def apply(df: DataFrame) -> DataFrame:
        parts = {"_year": F.year(src)} | {f"_{p}": e for p, e in date_parts(src).items()}
        keep = [F.col(f"`{c}`") for c in df.columns if c != col]
        return df.withColumns(parts).select(*keep, *new)

    out = kit.replace(apply(kit.train), apply(kit.test))
    return drop_constant_date_parts(out, list(exprs)) if drop_constant else out


def drop_constant_date_parts(kit: Kit, parts: list[str]) -> Kit:
    """Drop parts with one distinct value over train and test, nulls ignored."""
    gone = constant_over(kit.both().select(*parts), parts)
    return kit.replace(kit.train.drop(*gone), kit.test.drop(*gone))


def holiday_table(calendar: DataFrame, location: str) -> Fitted:
    """Distinct ``(location, _day)`` rows of a calendar ``(location, day)``."""
    return fitted(
        calendar.select(
            F.col("location").alias(location), F.col("day").cast("date").alias("_day"), F.lit(1).alias("_flag")
        ).distinct()
    )


def add_holidays(df: DataFrame, days: Fitted, date: str, location: str, out: str = "is_holiday") -> DataFrame:
    """0/1 flag: the day is a public holiday at the location.

    The calendar behind ``days`` is an input table.
    """
    keep = df.columns
    hit = attach(df.withColumn("_day", F.col(f"`{date}`").cast("date")), days, [location, "_day"])
    return hit.select(*keep, as_role(F.coalesce("_flag", F.lit(0)), out, "bin"))
