"""Numeric transforms, target transforms, mixtures and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.catalog.registry import query
from tabloom.catalog.views import ITEMS_SQL, KIT_SQL, items, order_kit, sql_mod, sql_normal, sql_unit, table
from tabloom.operators import folds as D
from tabloom.operators import scale as N
from tabloom.session import stored

Q = "WITH " + KIT_SQL
I = "WITH " + ITEMS_SQL


def _r(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query(
    "scale_standard",
    f"""{Q}, s AS (SELECT avg(balance) AS m, stddev_pop(balance) AS d, avg(nationkey) AS nm, stddev_pop(nationkey) AS nd FROM train)
        SELECT id, round((balance - m) / d, 6) + 0 AS balance, round((nationkey - nm) / nd, 6) + 0 AS nationkey FROM kit, s""",
)
def scale_standard(spark: SparkSession, sf: str) -> DataFrame:
    kit = order_kit(spark, sf)
    both = kit.both().select("id", "balance", "nationkey")
    return _r(N.scale_standard(kit.train, both, ["balance", "nationkey"]), "balance", "nationkey")


@query(
    "scale_minmax",
    f"""{Q}, s AS (SELECT min(balance) AS lo, max(balance) AS hi FROM train)
        SELECT id, round((balance - lo) / (hi - lo), 6) AS balance FROM kit, s""",
)
def scale_minmax(spark: SparkSession, sf: str) -> DataFrame:
    kit = order_kit(spark, sf)
    return _r(N.scale_minmax(kit.train, kit.both().select("id", "balance"), ["balance"]), "balance")


def _uniform_sql(c: str) -> str:
    """The mean of the interpolations on the grid ``g_c`` from below and from above."""
    ref = lambda k: f"({k} - 1) / (len(g_{c}) - 1)::DOUBLE"
    part = f"({c} - g_{c}[j_{c}]) / (g_{c}[j_{c} + 1] - g_{c}[j_{c}])"
    up = f"CASE WHEN j_{c} = 0 THEN 0 WHEN j_{c} = len(g_{c}) THEN 1 ELSE {ref(f'j_{c}')} + {part} / (len(g_{c}) - 1) END"
    part = f"(g_{c}[k_{c}] - {c}) / (g_{c}[k_{c}] - g_{c}[k_{c} - 1])"
    down = f"CASE WHEN k_{c} = 1 THEN 0 WHEN k_{c} > len(g_{c}) THEN 1 ELSE {ref(f'k_{c}')} - {part} / (len(g_{c}) - 1) END"
    return f"CASE WHEN {c} IS NOT NULL THEN round(({up} + {down}) / 2, 6) END AS {c}"


_SCALED = ("balance", "nationkey")


@query(
    "scale_quantile",
    f"""WITH {KIT_SQL}, n AS (SELECT least(1000, greatest(2, count(*))) AS n FROM train),
        p AS (SELECT list_transform(range(n), lambda i: i / (n - 1)::DOUBLE) AS p FROM n),
        g AS (SELECT {', '.join(f"(SELECT list(q ORDER BY i) FROM (SELECT i, lo + (hi - lo) * (h - floor(h)) AS q FROM (SELECT i, h, s[CAST(floor(h) AS BIGINT) + 1] AS lo, s[CAST(ceil(h) AS BIGINT) + 1] AS hi FROM (SELECT i, i * (len(s) - 1) / (n - 1)::DOUBLE AS h, s FROM (SELECT list(CAST({c} AS DOUBLE) ORDER BY {c}) FILTER ({c} IS NOT NULL) AS s FROM train), (SELECT n, unnest(range(n)) AS i FROM n))))) AS g_{c}" for c in _SCALED)}),
        x AS (SELECT id, {', '.join(f"CAST({c} AS DOUBLE) AS {c}, g_{c}, len(list_filter(g_{c}, lambda q: q <= CAST({c} AS DOUBLE))) AS j_{c}, len(list_filter(g_{c}, lambda q: q < CAST({c} AS DOUBLE))) + 1 AS k_{c}" for c in _SCALED)} FROM kit, g)
        SELECT id, {', '.join(_uniform_sql(c) for c in _SCALED)} FROM x""",
)
def scale_quantile(spark: SparkSession, sf: str) -> DataFrame:
    kit = order_kit(spark, sf)
    both = kit.both().select("id", *_SCALED)
    return _r(N.scale_quantile(kit.train, both, list(_SCALED)), *_SCALED)


def _spline_sql(j: int) -> str:
    u = f"(t - ({j - 3}))"
    terms = " ".join(
        f"{'+' if k % 2 == 0 else '-'} {c} * power(greatest({u} - {k}, 0), 3)" for k, c in enumerate((1, 4, 6, 4, 1))
    )
    return f"round(CASE WHEN {u} > 4 THEN 0 ELSE (0 {terms}) / 6 END, 6) + 0 AS q_sp_{j}"


@query(
    "spline_basis",
    f"""{I}, s AS (SELECT min(q) AS lo, max(q) AS hi FROM items), x AS (SELECT row_id, (q - lo) / ((hi - lo) / 4) AS t FROM items, s)
        SELECT row_id, {', '.join(_spline_sql(j) for j in range(7))} FROM x""",
)
def spline_basis(spark: SparkSession, sf: str) -> DataFrame:
    rows = stored(items(spark, sf).select("row_id", "q"), "items")
    return _r(N.spline_basis(rows, rows, ["q"], knots=5), *[f"q_sp_{j}" for j in range(7)])


@query("log_target", "SELECT o_orderkey, round(ln(1 + o_totalprice), 9) AS y, round(exp(ln(1 + o_totalprice)) - 1, 4) AS restored FROM orders")
def log_target(spark: SparkSession, sf: str) -> DataFrame:
    y = N.log_target(F.col("o_totalprice"))
    return table(spark, sf, "orders").select(
        "o_orderkey", F.round(y, 9).alias("y"), F.round(N.unlog_target(y), 4).alias("restored")
    )


@query(
    "standardize_target",
    f"""{Q}, s AS (SELECT avg(price) AS m, stddev_pop(price) AS d FROM train)
        SELECT id, round((price - m) / d * 2, 6) + 0 AS y, round((price - m) / d * 2 / 2 * d + m, 4) AS restored FROM train, s""",
)
def standardize_target(spark: SparkSession, sf: str) -> DataFrame:
    train = order_kit(spark, sf).train
    stats = N.target_stats(train, "price")
    y = N.standardize_target(F.col("price"), stats, 2.0)
    return train.select("id", F.round(y, 6).alias("y"), F.round(N.restore_target(y, stats, 2.0), 4).alias("restored"))


BALANCE = "SELECT c_custkey, c_acctbal AS y FROM customer"


@query(
    "bin_target_uniform",
    f"""WITH c AS ({BALANCE}), s AS (SELECT min(y) AS lo, max(y) AS hi FROM c)
        SELECT c_custkey, {' + '.join(f"CAST(y >= lo + (hi - lo) * {i} / 10 AS INTEGER)" for i in range(1, 10))} AS code FROM c, s""",
)
def bin_target_uniform(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    edges = N.bin_edges(c, "c_acctbal", 10, "uniform")
    return c.select("c_custkey", N.bin_code(F.col("c_acctbal"), edges).alias("code"))


QUANTILE_EDGES = f"""c AS ({BALANCE}), s AS (SELECT quantile_cont(y, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS e FROM c),
    b AS (SELECT c_custkey, y, e, {' + '.join(f"CAST(y >= e[{i}] AS INTEGER)" for i in range(2, 6))} AS code FROM c, s)"""


@query("bin_target", f"WITH {QUANTILE_EDGES} SELECT c_custkey, code FROM b")
def bin_target(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    edges = N.bin_edges(c, "c_acctbal", 5, "quantile")
    return c.select("c_custkey", N.bin_code(F.col("c_acctbal"), edges).alias("code"))


@query("bin_target_kmeans")
def bin_target_kmeans(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    edges = N.bin_edges(c, "c_acctbal", 5, "kmeans")
    return c.select("c_custkey", N.bin_code(F.col("c_acctbal"), edges).alias("code"))


@query("unbin_target", f"WITH {QUANTILE_EDGES} SELECT c_custkey, round((e[code + 1] + e[code + 2]) / 2, 6) AS y FROM b")
def unbin_target(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    edges = N.bin_edges(c, "c_acctbal", 5, "quantile")
    code = N.bin_code(F.col("c_acctbal"), edges)
    return c.select("c_custkey", F.round(N.unbin_middle(code, edges), 6).alias("y"))


@query(
    "unbin_target_uniform",
    f"WITH {QUANTILE_EDGES} SELECT c_custkey, round(e[code + 1] + {sql_unit(chr(39) + '5_' + chr(39) + ' || c_custkey')} * (e[code + 2] - e[code + 1]), 4) AS y FROM b",
)
def unbin_target_uniform(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    edges = N.bin_edges(c, "c_acctbal", 5, "quantile")
    code = N.bin_code(F.col("c_acctbal"), edges)
    return c.select("c_custkey", F.round(N.unbin_uniform(code, edges, 5, F.col("c_custkey")), 4).alias("y"))


def _mixture() -> tuple:
    w = F.array(F.col("q"), 51 - F.col("q"), F.lit(10.0))
    mu = F.array(F.col("price"), F.lit(1000.0), 100000 * F.col("d"))
    sigma = F.array(F.lit(5.0), F.col("q"), F.lit(1.0))
    return w, mu, sigma


MIX = "q * 1.0::DOUBLE AS w1, 51 - q AS w2, 10.0::DOUBLE AS w3, price AS m1, 1000.0::DOUBLE AS m2, 100000 * d AS m3, 5.0::DOUBLE AS s1, q AS s2, 1.0::DOUBLE AS s3"


@query("mixture_mean", f"{I}, x AS (SELECT row_id, {MIX} FROM items) SELECT row_id, round((w1 * m1 + w2 * m2 + w3 * m3) / (w1 + w2 + w3), 4) AS p FROM x")
def mixture_mean(spark: SparkSession, sf: str) -> DataFrame:
    w, mu, _ = _mixture()
    return items(spark, sf).select("row_id", F.round(N.mixture_mean(w, mu), 4).alias("p"))


@query(
    "mixture_sample",
    f"""{I}, x AS (SELECT row_id, {MIX}, {sql_unit("'11_' || row_id")} AS u, {sql_normal("'12_' || row_id")} AS z FROM items),
        k AS (SELECT *, u * (w1 + w2 + w3) AS v FROM x)
        SELECT row_id, round(CASE WHEN v < w1 THEN m1 + s1 * z WHEN v < w1 + w2 THEN m2 + s2 * z ELSE m3 + s3 * z END, 4) AS p FROM k""",
)
def mixture_sample(spark: SparkSession, sf: str) -> DataFrame:
    w, mu, sigma = _mixture()
    return items(spark, sf).select("row_id", F.round(N.mixture_sample(w, mu, sigma, 11, F.col("row_id")), 4).alias("p"))


@query(
    "silverman_bandwidth",
    "SELECT l_suppkey, count(l_extendedprice) AS n, round(stddev_samp(l_extendedprice) * power(count(l_extendedprice) * 3 / 4.0::DOUBLE, -1 / 5.0::DOUBLE), 4) AS bandwidth FROM lineitem GROUP BY 1",
)
def silverman_bandwidth(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return _r(N.silverman_bandwidth(li, ["l_suppkey"], "l_extendedprice"), "bandwidth", digits=4)


# --- folds ---------------------------------------------------------------------------


@query(
    "repeated_kfold",
    f"SELECT o_orderkey, CAST(r * 10 + {sql_mod(10, chr(39).join(['o_orderkey || ', '_', ' || r']))} AS INTEGER) AS fold FROM orders, (SELECT unnest([0, 1, 2]) AS r)",
)
def repeated_kfold(spark: SparkSession, sf: str) -> DataFrame:
    return D.repeated_kfold(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query(
    "fold_sizes",
    f"""WITH f AS (SELECT CAST(r * 10 + {sql_mod(10, chr(39).join(['o_orderkey || ', '_', ' || r']))} AS INTEGER) AS fold FROM orders, (SELECT unnest([0, 1, 2]) AS r))
        SELECT fold, (SELECT count(*) FROM orders) - count(*) AS n_train, count(*) AS n_valid FROM f WHERE fold BETWEEN 2 AND 24 GROUP BY 1""",
)
def fold_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return D.fold_sizes(table(spark, sf, "orders"), "o_orderkey", first=2, n=23)


@query("holdout_split", f"SELECT o_orderkey, {sql_mod(10, chr(39) + 'holdout_57_' + chr(39) + ' || o_orderkey')} = 0 AS is_stop FROM orders")
def holdout_split(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", D.holdout(F.col("o_orderkey")).alias("is_stop"))
