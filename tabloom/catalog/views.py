"""Tabular problems built from the given tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.spread import spread
from tabloom.meta import Kit, Meta, with_roles
from tabloom.operators.folds import fold_index, fold_of
from tabloom.session import stored


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- SQL snippets ------------------------------------------------------------


def sql_int(text: str, digits: int = 8) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, {digits}) AS BIGINT)"


def sql_mod(n: int, text: str) -> str:
    return f"CAST({sql_int(text)} % {n} AS INTEGER)"


def sql_unit(text: str) -> str:
    return f"((CAST({sql_int(text, 13)} AS DOUBLE) + CAST(0.5 AS DOUBLE)) / 4503599627370496.0::DOUBLE)"


def sql_normal(text: str) -> str:
    return (
        f"(sqrt(-2.0::DOUBLE * ln({sql_unit(text + chr(124) * 2 + chr(39) + '_r' + chr(39))})) * "
        f"cos(2 * pi() * {sql_unit(text + chr(124) * 2 + chr(39) + '_a' + chr(39))}))"
    )


# --- kit: orders with their customers ------------------------------------------

ROLES = {
    "id": "id",
    "price": "target",
    "status": "target",
    "balance": "num",
    "nationkey": "num",
    "priority": "cat",
    "segment": "cat",
    "place": "location",
    "ordered": "date",
}
SPLIT_DAY = "2000-01-01"

KIT_SQL = f"""
kit AS (
  SELECT o_orderkey AS id, o_totalprice AS price, o_orderstatus AS status,
         CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance, n_nationkey AS nationkey,
         CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END AS priority,
         c_mktsegment AS segment, n_name AS place, o_orderdate AS ordered,
         o_orderdate >= TIMESTAMP '{SPLIT_DAY}' AS is_test
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
train AS (SELECT * FROM kit WHERE NOT is_test),
test AS (SELECT * FROM kit WHERE is_test)"""


def kit_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with customer attributes; unspecified priorities and overdrawn balances are gaps."""
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
    customer = table(spark, sf, "customer").join(
        F.broadcast(nation),  # 25 rows at every scale
        F.col("c_nationkey") == F.col("n_nationkey"),
    )
    orders = table(spark, sf, "orders")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id"),
        F.col("o_totalprice").alias("price"),
        F.col("o_orderstatus").alias("status"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"),
        F.col("n_nationkey").alias("nationkey"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority")).alias("priority"),
        F.col("c_mktsegment").alias("segment"),
        F.col("n_name").alias("place"),
        F.col("o_orderdate").alias("ordered"),
    )


def order_kit(spark: SparkSession, sf: str, target: str = "price", extra: dict[str, Column] | None = None) -> Kit:
    """Train before the split day, test from it on."""
    rows = with_roles(kit_rows(spark, sf), ROLES)
    if extra:
        rows = with_roles(rows.withColumns(extra), {c: "num" for c in extra})
    late = F.col("ordered") >= F.lit(SPLIT_DAY).cast("timestamp_ntz")
    meta = Meta(
        title="orders",
        id_col="id",
        target_cols=[target],
        prediction_type="regression" if target == "price" else "classification",
        score_name="rmse" if target == "price" else "accuracy",
        roles={c: r for c, r in ROLES.items() if r != "target"},
    )
    return Kit(rows.where(~late), rows.where(late), meta)


def all_rows(kit: Kit, *cols: str) -> DataFrame:
    """Chosen columns of both tables."""
    return kit.train.select(*cols).unionByName(kit.test.select(*cols))


# --- predictions: closed formulas over line items ---------------------------------

ITEMS_SQL = """
items AS (
  SELECT l_orderkey * 10 + l_linenumber AS row_id, max(l_extendedprice) AS price,
         max(l_quantity) AS q, max(l_discount) AS d, max(l_tax) AS tax, max(l_returnflag) AS flag
  FROM lineitem GROUP BY 1)"""


def items(spark: SparkSession, sf: str) -> DataFrame:
    """Line items, one row per id; what is made of a row stays in its task, of bounded size."""
    li = table(spark, sf, "lineitem")
    rows = li.withColumn("row_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return spread(rows, li.count(), "row_id").groupBy("row_id").agg(
        F.max("l_extendedprice").alias("price"),
        F.max("l_quantity").alias("q"),
        F.max("l_discount").alias("d"),
        F.max("l_tax").alias("tax"),
        F.max("l_returnflag").alias("flag"),
    )


PRICE_FORMULAS = {
    "flat": "35000 + 20000 * d",
    "slope": "1480 * q + 500",
    "steep": "1700 * q - 3000 * d + 100",
}
SHARE_FORMULAS = {
    "by_amount": "q / 60 + 0.05",
    "by_discount": "0.2 + 5 * d",
    "mixed": "q / 120 + 2 * d + 0.1",
}


def _sql_preds(y: str, formulas: dict[str, str]) -> str:
    parts = [
        f"SELECT '{n}' AS submission, {sql_mod(10, 'row_id || ' + repr('_0'))} AS fold, row_id, {y} AS y, {f} AS p FROM items"
        for n, f in formulas.items()
    ]
    return "preds AS (" + " UNION ALL ".join(parts) + ")"


PRED_SQL = f"{ITEMS_SQL}, {_sql_preds('price', PRICE_FORMULAS)}"
SHARE_SQL = f"{ITEMS_SQL}, {_sql_preds('CASE WHEN flag = ' + repr('R') + ' THEN 1 ELSE 0 END', SHARE_FORMULAS)}"
LABEL_SQL = f"""{ITEMS_SQL}, preds AS (
  SELECT 'by_amount' AS submission, {sql_mod(10, "row_id || '_0'")} AS fold, row_id, flag AS y,
         CASE WHEN q > 34 THEN 'R' WHEN q > 17 THEN 'N' ELSE 'A' END AS p FROM items)"""


def _long(rows: DataFrame, y: Column, formulas: dict[str, str], *more: str) -> DataFrame:
    """A row per submission, with the row's id if it has one. Columns named in ``more`` pass through the exploded structs.

    Spark computes what stands beside an explode anew for each element, and what
    the elements refer to once.
    """
    subs = F.array(*[F.struct(F.lit(n).alias("submission"), F.expr(f).alias("p"), *more) for n, f in formulas.items()])
    ids = [c for c in rows.columns if c == "row_id"]
    long = rows.select(*ids, y.alias("y"), F.explode(subs).alias("s"))
    return long.select("s.submission", *[f"s.{c}" for c in more], *ids, "y", "s.p")


def _folded(spark: SparkSession, sf: str) -> DataFrame:
    return items(spark, sf).withColumn("fold", fold_of(F.col("row_id"), 0))


def price_preds(spark: SparkSession, sf: str) -> DataFrame:
    return _long(_folded(spark, sf), F.col("price"), PRICE_FORMULAS, "fold")


def kept_price_preds(spark: SparkSession, sf: str) -> DataFrame:
    """``price_preds`` without row ids, for scores that read them several times: formulas over line items stored once."""
    rows = stored(_folded(spark, sf).select("price", "q", "d", "fold"), "items")
    return _long(rows, F.col("price"), PRICE_FORMULAS, "fold")


def share_preds(spark: SparkSession, sf: str) -> DataFrame:
    return _long(_folded(spark, sf), (F.col("flag") == "R").cast("int"), SHARE_FORMULAS, "fold")


def label_preds(spark: SparkSession, sf: str) -> DataFrame:
    return items(spark, sf).select(
        F.lit("by_amount").alias("submission"),
        fold_of(F.col("row_id"), 0).alias("fold"),
        "row_id",
        F.col("flag").alias("y"),
        F.expr("CASE WHEN q > 34 THEN 'R' WHEN q > 17 THEN 'N' ELSE 'A' END").alias("p"),
    )


REPEAT_SQL = f"""{ITEMS_SQL}, repeats AS (SELECT unnest([0, 1, 2]) AS r),
preds AS (
  SELECT submission, r * 10 + {sql_mod(10, "row_id || '_' || r")} AS fold, row_id, y, p
  FROM (
    {' UNION ALL '.join(f"SELECT '{n}' AS submission, row_id, price AS y, {f} AS base FROM items" for n, f in PRICE_FORMULAS.items())}
  ) s, repeats, LATERAL (SELECT base + 10 * (r * 10 + {sql_mod(10, "row_id || '_' || r")}) AS p))"""


def repeated_preds(spark: SparkSession, sf: str) -> DataFrame:
    """Three held-out predictions per row and submission, shifted by fold."""
    long = _long(items(spark, sf), F.col("price"), PRICE_FORMULAS)
    folds = F.array(*[fold_index(F.col("row_id"), r) for r in range(3)])
    out = long.withColumn("fold", F.explode(folds))
    return out.withColumn("p", F.col("p") + 10 * F.col("fold"))


# --- trials: parts scored on line numbers ---------------------------------------

FOLDS = [1, 2, 3, 4, 5, 6, 7]

TRIALS_SQL = """
trials AS (
  SELECT 'base' || (l_partkey % 3) || '_hyperopt_' || l_partkey AS submission, l_linenumber AS fold,
         round(CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100, 3) AS valid,
         round(CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100, 3) AS train,
         CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS seconds,
         any_value(p_size) AS hyper_size, any_value(p_brand) AS hyper_brand
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_partkey, l_linenumber)"""

FULL_SQL = f"""{TRIALS_SQL},
full_trials AS (SELECT * FROM trials WHERE submission IN (
  SELECT submission FROM trials GROUP BY submission HAVING count(fold) = {len(FOLDS)}))"""


def trials(spark: SparkSession, sf: str) -> DataFrame:
    """A trial per part and a fold per line number, scored by the mean discount."""
    cents = lambda c: F.sum(F.round(F.col(c) * 100).cast("long")).cast("double")
    n = F.count(F.lit(1))
    per = table(spark, sf, "lineitem").groupBy("l_partkey", "l_linenumber").agg(
        F.round(cents("l_discount") / n / 100, 3).alias("valid"),
        F.round(cents("l_tax") / n / 100, 3).alias("train"),
        F.sum(F.col("l_quantity").cast("long")).cast("double").alias("seconds"),
    )
    parts = table(spark, sf, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("hyper_size"), F.col("p_brand").alias("hyper_brand")
    )
    return per.join(parts, "l_partkey").select(
        F.concat(F.lit("base"), (F.col("l_partkey") % 3).cast("string"), F.lit("_hyperopt_"), F.col("l_partkey").cast("string")).alias("submission"),
        F.col("l_linenumber").alias("fold"),
        "valid", "train", "seconds", "hyper_size", "hyper_brand",
    )


# --- run log: a user's events are the actions of a run --------------------------

LOG_SQL = """
log AS (
  SELECT user_id AS run, event_id AS action_id,
         CASE event_type WHEN 'click' THEN 'search' WHEN 'view' THEN 'blend' WHEN 'purchase' THEN 'final' ELSE event_type END AS name,
         'base' || (event_id % 3) AS base, 0 AS fold_lo,
         CASE WHEN CAST(regexp_extract(props, '[0-9]+') AS INTEGER) < 50 THEN 3 ELSE 30 END AS fold_hi,
         epoch_us(ts) AS start_us, epoch_us(ts) + CAST(round(value * 1000000) AS BIGINT) AS stop_us,
         value AS score, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k
  FROM events),
timed AS (SELECT *, CAST(stop_us - start_us AS DOUBLE) / 1000000 AS seconds FROM log)"""


def run_log(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    members = F.create_map(
        F.lit("base0_hyperopt_x"), k, F.lit("base1_hyperopt_y"), (k % 7).cast("int"), F.lit("base2_hyperopt_z"), F.lit(0)
    )
    name = (
        F.when(F.col("event_type") == "click", "search")
        .when(F.col("event_type") == "view", "blend")
        .when(F.col("event_type") == "purchase", "final")
        .otherwise(F.col("event_type"))
    )
    return e.select(
        F.col("user_id").alias("run"),
        F.col("event_id").alias("action_id"),
        name.alias("name"),
        F.concat(F.lit("base"), (F.col("event_id") % 3).cast("string")).alias("base"),
        F.lit(0).alias("fold_lo"),
        F.when(k < 50, 3).otherwise(30).alias("fold_hi"),
        F.col("ts").cast("timestamp").alias("start_ts"),
        F.timestamp_micros(start + F.round(F.col("value") * 1_000_000).cast("long")).alias("stop_ts"),
        F.col("value").alias("score"),
        members.alias("contributivities"),
        k.alias("round_idx"),
    )


def micros(c: str) -> Column:
    return F.unix_micros(F.col(c))
