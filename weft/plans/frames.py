"""Queries of frame operators: groups, reductions, windows, joins, order, shape, missing data, flows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..frame import Frame
from ..operators import join as J
from ..operators import reshape as R
from .registry import query, rounded

L = ["l_returnflag", "l_linestatus"]
BY = "l_returnflag, l_linestatus"
V, Q = "l_extendedprice", "l_quantity"


@query("pricing_summary", f"SELECT {BY}, round(sum({Q}), 2) AS sum_qty, round(sum({V}), 2) AS sum_base_price, round(sum({V} * (1 - l_discount)), 2) AS sum_disc_price, round(avg({Q}), 4) AS avg_qty, count(*) AS count_order FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-12-31' GROUP BY ALL")
def _(get):
    f = get("lineitem")
    f = f[f["l_shipdate"] <= F.lit("2001-12-31").cast("timestamp_ntz")].assign(disc=lambda x: x[V] * (1 - x["l_discount"]))
    out = f.groupby(L).agg(sum_qty=(Q, "sum"), sum_base_price=(V, "sum"), sum_disc_price=("disc", "sum"), avg_qty=(Q, "mean"), count_order=(Q, "size")).df
    return out.withColumns({c: F.round(c, 2) for c in ("sum_qty", "sum_base_price", "sum_disc_price")} | {"avg_qty": F.round("avg_qty", 4)})


# ---- reductions: by group and over the whole frame
_skew = "CASE WHEN count({c}) >= 3 THEN skewness({c}) END"
_kurt = "CASE WHEN count({c}) >= 4 THEN kurtosis({c}) END"
REDUCE = {"sum": "sum({c})", "mean": "avg({c})", "min": "min({c})", "max": "max({c})", "count": "count({c})", "size": "count(*)", "nunique": "count(DISTINCT {c})", "median": "median({c})", "q25": "quantile_cont({c}, 0.25)", "q75": "quantile_cont({c}, 0.75)", "var": "var_samp({c})", "std": "stddev_samp({c})", "var_pop": "var_pop({c})", "std_pop": "stddev_pop({c})", "sem": "stddev_samp({c}) / sqrt(count({c}))", "skew": _skew, "kurt": _kurt}
for how, sql in REDUCE.items():
    one = sql.format(c=Q)
    query(f"groupby_{how}", f"SELECT {BY}, round(CAST({one} AS DOUBLE), 4) AS r FROM lineitem GROUP BY ALL")(lambda get, how=how: rounded(get("lineitem").groupby(L).agg(r=(Q, how)).df.withColumn("r", F.col("r").cast("double"))))
    query(f"reduce_{how}", f"SELECT round(CAST({one} AS DOUBLE), 4) AS r FROM lineitem")(lambda get, how=how: rounded(get("lineitem").agg(r=(Q, how)).df.withColumn("r", F.col("r").cast("double"))))
for how, sql in {"any": "bool_or(value > 100)", "all": "bool_and(value >= 0)"}.items():
    query(f"groupby_{how}", f"SELECT event_type, {sql} AS r FROM events GROUP BY ALL")(lambda get, how=how: get("events").assign(b=lambda f: f["value"] > 100 if how == "any" else f["value"] >= 0).groupby("event_type").agg(r=("b", how)))
    query(f"reduce_{how}", f"SELECT {sql} AS r FROM events")(lambda get, how=how: get("events").assign(b=lambda f: f["value"] > 100 if how == "any" else f["value"] >= 0).agg(r=("b", how)))
for how, sql in {"first": "arg_min(value, event_id)", "last": "arg_max(value, event_id)", "idxmax": "arg_min(event_id, (-value, event_id))", "idxmin": "arg_min(event_id, (value, event_id))"}.items():
    query(f"groupby_{how}", f"SELECT user_id, {sql} AS r FROM events GROUP BY ALL")(lambda get, how=how: get("events").groupby("user_id").agg(r=("value", how)))
    query(f"reduce_{how}", f"SELECT {sql} AS r FROM events")(lambda get, how=how: get("events").agg(r=("value", how)))
query("groupby_prod", "SELECT o_orderstatus, round(product(1 + o_custkey % 3 / 1e6), 8) AS r FROM orders GROUP BY ALL")(lambda get: rounded(get("orders").assign(x=lambda f: f["o_custkey"] % 3 / 1e6 + 1).groupby("o_orderstatus").agg(r=("x", "prod")).df, 8))
query("reduce_prod", "SELECT round(product(1 + o_custkey % 3 / 1e6), 8) AS r FROM orders")(lambda get: rounded(get("orders").assign(x=lambda f: f["o_custkey"] % 3 / 1e6 + 1).agg(r=("x", "prod")).df, 8))
query("reduce_sum_empty", "SELECT CAST(0 AS DOUBLE) AS zero, CAST(NULL AS DOUBLE) AS missing, CAST(1 AS DOUBLE) AS one")(lambda get: (lambda e: Frame(e.df.agg(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)).alias("zero"), F.sum("o_totalprice").alias("missing"), F.coalesce(F.product("o_totalprice"), F.lit(1.0)).alias("one"))))(get("orders").query("o_orderkey < 0")))
query("groupby_str_concat", "SELECT r_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS r FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")(lambda get: Frame(get("nation").merge(get("region"), left_on="n_regionkey", right_on="r_regionkey").df, ["n_nationkey"]).groupby("r_regionkey").agg(r=("n_name", "str_concat")))
query("groupby_mode", "SELECT o_custkey % 10 AS k, min(o_orderpriority) AS r FROM (SELECT o_custkey, o_orderpriority, rank() OVER (PARTITION BY o_custkey % 10 ORDER BY n DESC) AS p FROM (SELECT o_custkey % 10 AS o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)) WHERE p = 1 GROUP BY ALL")(lambda get: get("orders").assign(k=lambda f: f["o_custkey"] % 10).df.withColumn("k", F.col("k").cast("bigint")).groupBy("k").agg(F.mode("o_orderpriority", True).alias("r")))
query("groupby_dropna_false", "SELECT nullif(o_orderstatus, 'P') AS k, count(*) AS n FROM orders GROUP BY ALL")(lambda get: get("orders").assign(k=lambda f: f["o_orderstatus"].mask(f["o_orderstatus"] == "P")).groupby("k", dropna=False).agg(n=("o_orderkey", "size")))
query("groupby_dropna", "SELECT o_orderstatus AS k, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL")(lambda get: get("orders").assign(k=lambda f: f["o_orderstatus"].mask(f["o_orderstatus"] == "P")).groupby("k").agg(n=("o_orderkey", "size")))
query("groupby_multi_agg", "SELECT event_type, round(min(value), 4) AS value_min, round(max(value), 4) AS value_max, count(DISTINCT user_id) AS user_id_nunique FROM events GROUP BY ALL")(lambda get: rounded(get("events").groupby("event_type").agg({"value": ["min", "max"], "user_id": "nunique"}).df))
query("groupby_custom_reduction", "SELECT event_type, round(max(value) - min(value), 4) AS spread FROM events GROUP BY ALL")(lambda get: rounded(get("events").groupby("event_type").agg(spread=("value", lambda c: F.max(c) - F.min(c))).df))
query("series_agg_many", "SELECT count(value) AS count, round(sum(value), 4) AS sum, max(value) AS max FROM events")(lambda get: rounded(get("events")["value"].agg("count", "sum", "max").df))
query("series_quantile", "SELECT q, round(r, 6) AS value FROM (SELECT unnest([0.1, 0.5, 0.9])::DOUBLE AS q, unnest(quantile_cont(value, [0.1, 0.5, 0.9])) AS r FROM events)")(lambda get: rounded(get("events")["value"].quantile([0.1, 0.5, 0.9]).df, 6))
query("describe", "SELECT 'o_totalprice' AS \"column\", CAST(count(o_totalprice) AS DOUBLE) AS count, round(avg(o_totalprice), 3) AS mean, round(stddev_samp(o_totalprice), 3) AS std, min(o_totalprice) AS min, round(quantile_cont(o_totalprice, 0.25), 3) AS q25, round(median(o_totalprice), 3) AS median, round(quantile_cont(o_totalprice, 0.75), 3) AS q75, max(o_totalprice) AS max FROM orders")(lambda get: rounded(get("orders").describe(["o_totalprice"]).df, 3))
query("value_counts", "SELECT o_orderpriority, count(*) AS count FROM orders GROUP BY ALL")(lambda get: get("orders")["o_orderpriority"].value_counts())
query("value_counts_normalize", "SELECT o_orderpriority, round(count(*) / (SELECT count(*) FROM orders), 8) AS proportion FROM orders GROUP BY ALL")(lambda get: rounded(get("orders")["o_orderpriority"].value_counts(normalize=True).df, 8))
query("unique", "SELECT DISTINCT p_brand FROM part")(lambda get: get("part")["p_brand"].unique())
query("mode", "SELECT p_size FROM part GROUP BY ALL HAVING count(*) = (SELECT max(n) FROM (SELECT count(*) AS n FROM part GROUP BY p_size))")(lambda get: get("part")["p_size"].mode())
query("is_unique", "SELECT count(DISTINCT o_custkey) = count(*) AS is_unique FROM orders")(lambda get: get("orders")["o_custkey"].is_unique())
query("is_monotonic", "SELECT true AS is_monotonic")(lambda get: get("events")["event_id"].is_monotonic())

# ---- windows over rows in order (events by event_id)
_known = lambda f: f.assign(x=f["value"].where(f["value"] > 20))
for name, sql, make in [
    ("shift", "lag(value, 2) OVER w", lambda f: f.shifted("value", "r", 2)),
    ("shift_back", "lead(value, 3) OVER w", lambda f: f.shifted("value", "r", -3)),
    ("diff", "value - lag(value) OVER w", lambda f: f.differences("value", "r")),
    ("pct_change", "value / nullif(lag(value) OVER w, 0) - 1", lambda f: f.changes("value", "r")),
    ("cumsum", "sum(value) OVER w", lambda f: f.cumulative("value", "sum", "r")),
    ("cummax", "max(value) OVER w", lambda f: f.cumulative("value", "max", "r")),
    ("cummin", "min(value) OVER w", lambda f: f.cumulative("value", "min", "r")),
    ("cumcount", "row_number() OVER w - 1", lambda f: f.with_row_number("r")),
    ("ffill", "last_value(CASE WHEN value > 20 THEN value END IGNORE NULLS) OVER w", lambda f: _known(f).filled("x", "r")),
    ("bfill", "first_value(CASE WHEN value > 20 THEN value END IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)", lambda f: _known(f).filled("x", "r", True)),
    ("rank_average", "rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0", lambda f: f.ranked("value", "r")),
    ("rank_dense_desc", "dense_rank() OVER (ORDER BY value DESC)", lambda f: f.ranked("value", "r", "dense", ascending=False)),
    ("rank_max", "rank() OVER (ORDER BY value) + count(*) OVER (PARTITION BY value) - 1", lambda f: f.ranked("value", "r", "max")),
    ("rank_first", "row_number() OVER (ORDER BY value, event_id)", lambda f: f.ranked("value", "r", "first")),
    ("rank_first_desc", "row_number() OVER (ORDER BY value DESC, event_id)", lambda f: f.ranked("value", "r", "first", ascending=False)),
    ("rank_missing", "CASE WHEN value > 20 THEN rank() OVER (ORDER BY CASE WHEN value > 20 THEN value END NULLS LAST) END", lambda f: _known(f).ranked("x", "r", "min")),
    ("rank_pct", "rank() OVER (ORDER BY value) / (SELECT count(*) FROM events)::DOUBLE", lambda f: f.ranked("value", "r", "min", pct=True)),
    ("argsort", "row_number() OVER (ORDER BY value, event_id) - 1", lambda f: f.ranked("value", "r", "first").assign(r=F.col("r") - 1)),
]:
    query(f"window_{name}", f"SELECT event_id, round(CAST({sql} AS DOUBLE), 7) AS r FROM events WINDOW w AS (ORDER BY event_id)")(lambda get, make=make: make(get("events")[["event_id", "value"]]).df.select("event_id", F.round(F.col("r").cast("double"), 7).alias("r")))
ROLL = {"sum": "sum(value)", "mean": "avg(value)", "min": "min(value)", "max": "max(value)", "std": "stddev_samp(value)", "var": "var_samp(value)", "median": "median(value)"}
for how, sql in ROLL.items():
    query(f"rolling_{how}", f"SELECT event_id, CASE WHEN count(value) OVER w >= 5 THEN round({sql} OVER w, 7) END AS r FROM events WINDOW w AS (ORDER BY event_id ROWS 4 PRECEDING)")(lambda get, how=how: rounded(get("events")[["event_id", "value"]].moving("value", 5, how, "r").df.select("event_id", "r"), 7))
    if how != "median":
        query(f"groupby_rolling_{how}", f"SELECT event_id, CASE WHEN count(value) OVER w >= 2 THEN round({sql} OVER w, 7) END AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS 3 PRECEDING)")(lambda get, how=how: rounded(get("events").groupby("user_id").rolling("value", 4, how, "r", 2).df.select("event_id", "r"), 7))
        query(f"groupby_expanding_{how}", f"SELECT event_id, CASE WHEN count(value) OVER w >= 3 THEN round({sql} OVER w, 9) END AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")(lambda get, how=how: rounded(get("events").groupby("user_id").expanding("value", how, "r", 3).df.select("event_id", "r"), 9))
query("rolling_center", "SELECT event_id, round(sum(value) OVER (ORDER BY event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 7) AS r FROM events")(lambda get: rounded(get("events")[["event_id", "value"]].moving("value", 3, "sum", "r", 1, True).df.select("event_id", "r"), 7))
query("expanding_mean", "SELECT event_id, round(avg(value) OVER (ORDER BY event_id) + 1e-6, 4) AS r FROM events")(lambda get: rounded(get("events")[["event_id", "value"]].growing("value", "mean", "r").df.select("event_id", (F.col("r") + 1e-6).alias("r"))))
query("series_shift_expression", "SELECT event_id, lag(value, 2) OVER (ORDER BY event_id) AS r FROM events")(lambda get: (lambda f: f.df.select("event_id", f["value"].shift(2).column.alias("r")))(get("events")))
query("ewm_mean", "WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) SELECT a.event_id, round(sum(b.value * pow(0.5, a.k - b.k)) / sum(pow(0.5, a.k - b.k)), 6) AS r FROM e a JOIN e b ON a.user_id = b.user_id AND b.k <= a.k GROUP BY ALL")(lambda get: rounded(get("events")[["event_id", "user_id", "value"]].ewm("value", 0.5, ["user_id"], "r").df.select("event_id", "r"), 6))

# ---- windows within groups (events by user_id)
for name, sql, make in [
    ("shift", "lag(value) OVER w", lambda g: g.shift("value", "r")),
    ("diff", "value - lag(value) OVER w", lambda g: g.diff("value", "r")),
    ("cumsum", "sum(value) OVER w", lambda g: g.cumsum("value", "r")),
    ("cummax", "max(value) OVER w", lambda g: g.cummax("value", "r")),
    ("cummin", "min(value) OVER w", lambda g: g.cummin("value", "r")),
    ("cumcount", "row_number() OVER w - 1", lambda g: g.cumcount("r")),
    ("rank", "rank() OVER (PARTITION BY user_id ORDER BY value) + (count(*) OVER (PARTITION BY user_id, value) - 1) / 2.0", lambda g: g.rank("value", "r")),
    ("transform_mean", "avg(value) OVER (PARTITION BY user_id)", lambda g: g.transform("value", "mean", "r")),
    ("transform_sum", "sum(value) OVER (PARTITION BY user_id)", lambda g: g.transform("value", "sum", "r")),
]:
    query(f"groupby_{name}", f"SELECT event_id, round(CAST({sql} AS DOUBLE), 7) AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")(lambda get, make=make: (lambda d: d.select("event_id", F.round(F.col("r").cast("double"), 7).alias("r")))(make(get("events").groupby("user_id")).df))
query("groupby_cumprod", "SELECT event_id, round(product(1 + value / 1e6) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS r FROM events")(lambda get: rounded(get("events").assign(x=lambda f: f["value"] / 1e6 + 1).groupby("user_id").cumprod("x", "r").df.select("event_id", "r"), 6))
query("groupby_ffill", "SELECT event_id, last_value(CASE WHEN value > 20 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events")(lambda get: get("events").assign(x=lambda f: f["value"].where(f["value"] > 20)).groupby("user_id").ffill("x", "r")[["event_id", "r"]])
query("groupby_bfill", "SELECT event_id, first_value(CASE WHEN value > 20 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r FROM events")(lambda get: get("events").assign(x=lambda f: f["value"].where(f["value"] > 20)).groupby("user_id").bfill("x", "r")[["event_id", "r"]])
query("groupby_head", "SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 3")(lambda get: get("events").groupby("user_id").head(3)[["event_id"]])
query("groupby_tail", "SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 3")(lambda get: get("events").groupby("user_id").tail(3)[["event_id"]])
query("groupby_nth", "SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 3")(lambda get: get("events").groupby("user_id").nth(2)[["event_id"]])
query("groupby_sample")(lambda get: get("events").groupby("user_id").sample(2, seed=1)[["user_id", "event_id"]])


def _range(group: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"user_id": [group.user_id.iloc[0]], "spread": [group.value.max() - group.value.min()], "n": [len(group)]})


query("groupby_apply", "SELECT user_id, round(max(value) - min(value), 4) AS spread, count(*) AS n FROM events GROUP BY ALL")(lambda get: rounded(get("events").groupby("user_id").apply(_range, "user_id bigint, spread double, n bigint").df))

# ---- joins and combination
C = "c_custkey, c_name"
query("merge_inner", "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")(lambda get: get("nation").merge(get("region"), left_on="n_regionkey", right_on="r_regionkey")[["n_nationkey", "n_name", "r_name"]])
query("merge_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")(lambda get: get("customer").merge(get("orders"), left_on="c_custkey", right_on="o_custkey", how="left")[["c_custkey", "o_orderkey"]])
query("merge_right", "SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 5000) RIGHT JOIN orders ON c_custkey = o_custkey")(lambda get: get("customer").query("c_acctbal > 5000").merge(get("orders"), left_on="c_custkey", right_on="o_custkey", how="right")[["c_custkey", "o_orderkey"]])
query("merge_outer_indicator", "SELECT c_custkey, s_suppkey, CASE WHEN c_custkey IS NULL THEN 'right_only' WHEN s_suppkey IS NULL THEN 'left_only' ELSE 'both' END AS _merge FROM (SELECT * FROM customer WHERE c_custkey >= 50) FULL JOIN supplier ON c_custkey = s_suppkey")(lambda get: get("customer").query("c_custkey >= 50").merge(get("supplier"), left_on="c_custkey", right_on="s_suppkey", how="outer", indicator=True)[["c_custkey", "s_suppkey", "_merge"]])
query("merge_on_suffixes", "SELECT a.k, a.o_orderkey AS o_orderkey_x, b.o_orderkey AS o_orderkey_y FROM (SELECT o_custkey AS k, o_orderkey FROM orders WHERE o_orderstatus = 'F') a JOIN (SELECT o_custkey AS k, o_orderkey FROM orders WHERE o_orderstatus = 'P') b USING (k)")(lambda get: (lambda o: o.query("o_orderstatus == 'F'")[["k", "o_orderkey"]].merge(o.query("o_orderstatus == 'P'")[["k", "o_orderkey"]], on="k"))(get("orders").rename({"o_custkey": "k"})))

_keys_alike = "SELECT a.p_partkey AS x, b.p_partkey AS y FROM (SELECT p_partkey, nullif(p_size % 50, 0) AS k FROM part) a JOIN (SELECT p_partkey, nullif(p_size % 50, 0) AS k FROM part) b ON a.k IS NOT DISTINCT FROM b.k"
for _name in ("merge_missing_keys", "merge_missing_keys_whole"):
    query(_name, _keys_alike)(lambda get: (lambda p: J.merge(p.df.select(F.col("p_partkey").alias("x"), "k"), p.df.select(F.col("p_partkey").alias("y"), "k"), "k", many=True).drop("k"))(get("part").assign(k=F.expr("nullif(p_size % 50, 0)"))))
query("merge_semi", f"SELECT {C} FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")(lambda get: get("customer").merge(get("orders").query("o_totalprice > 400000"), left_on="c_custkey", right_on="o_custkey", how="semi")[["c_custkey", "c_name"]])
query("merge_anti", f"SELECT {C} FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")(lambda get: get("customer").merge(get("orders"), left_on="c_custkey", right_on="o_custkey", how="anti")[["c_custkey", "c_name"]])
query("join_index", "SELECT k, n, total FROM (SELECT user_id AS k, count(*) AS n FROM events GROUP BY ALL) LEFT JOIN (SELECT o_custkey AS k, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL) USING (k)")(lambda get: rounded(get("events").rename({"user_id": "k"}).groupby("k").agg(n=("event_id", "size")).join(get("orders").rename({"o_custkey": "k"}).groupby("k").agg(total=("o_totalprice", "sum"))).df, 2))
query("concat_outer", "SELECT c_custkey AS k, c_name AS name, c_mktsegment AS seg FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")(lambda get: J.concat([get("customer").df.selectExpr("c_custkey k", "c_name name", "c_mktsegment seg"), get("supplier").df.selectExpr("s_suppkey k", "s_name name")]))
query("concat_inner", "SELECT c_custkey AS k FROM customer UNION ALL SELECT s_suppkey FROM supplier")(lambda get: J.concat([get("customer").df.selectExpr("c_custkey k", "c_name a"), get("supplier").df.selectExpr("s_suppkey k", "s_name b")], "inner"))
query("append", "SELECT * FROM nation UNION ALL SELECT * FROM nation")(lambda get: get("nation").append(get("nation")))
_pair = lambda get: (Frame(get("customer").df.selectExpr("c_custkey k", "nullif(c_nationkey, 3) v"), ["k"], ["k"]), Frame(get("supplier").df.selectExpr("s_suppkey k", "s_nationkey v", "s_acctbal w"), ["k"], ["k"]))
_ab = "WITH a AS (SELECT c_custkey AS k, nullif(c_nationkey, 3) AS v FROM customer), b AS (SELECT s_suppkey AS k, s_nationkey AS v, s_acctbal AS w FROM supplier) "
query("combine_first", _ab + "SELECT k, coalesce(a.v, b.v) AS v, w FROM a FULL JOIN b USING (k)")(lambda get: (lambda p: p[0].combine_first(p[1]))(_pair(get)))
query("combine", _ab + "SELECT k, coalesce(a.v, 0) + coalesce(b.v, 0) AS v FROM a FULL JOIN b USING (k)")(lambda get: (lambda p: J.combine(p[0].df, p[1].df, ["k"], lambda x, y: x + y, 0))(_pair(get)))
query("update", _ab + "SELECT k, coalesce(b.v, a.v) AS v FROM a LEFT JOIN b USING (k)")(lambda get: (lambda p: p[0].update(p[1]))(_pair(get)))
query("compare", _ab + "SELECT k, a.v AS v_self, b.v AS v_other FROM a JOIN b USING (k) WHERE a.v IS DISTINCT FROM b.v")(lambda get: (lambda p: p[0].compare(p[1]))(_pair(get)))
query("align", _ab + "SELECT k, a.v FROM a FULL JOIN b USING (k)")(lambda get: (lambda p: p[0].align(p[1])[0])(_pair(get)))

# ---- selection and labels
query("filter_mask", "SELECT o_orderkey FROM orders WHERE o_totalprice > 300000 AND o_orderstatus = 'F'")(lambda get: (lambda f: f[(f["o_totalprice"] > 300000) & (f["o_orderstatus"] == "F")][["o_orderkey"]])(get("orders")))
query("query_expression", "SELECT o_orderkey FROM orders WHERE o_totalprice > 300000 AND o_custkey % 7 = 2 AND o_orderstatus IN ('F', 'O')")(lambda get: get("orders").query("o_totalprice > 300000 and o_custkey % 7 == 2 and o_orderstatus in ('F', 'O')")[["o_orderkey"]])
query("eval", "SELECT o_orderkey, round(o_totalprice * 1.1 - o_custkey, 4) AS x FROM orders")(lambda get: rounded(get("orders").eval("x = o_totalprice * 1.1D - o_custkey")[["o_orderkey", "x"]].df))
query("loc_slice", "SELECT o_orderkey FROM orders WHERE o_orderkey BETWEEN 100 AND 200")(lambda get: get("orders").loc(100, 200)[["o_orderkey"]])
query("loc_labels", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (5, 7, 11)")(lambda get: get("orders").loc(labels=[5, 7, 11])[["o_orderkey"]])
query("iloc", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 15 OFFSET 10")(lambda get: get("orders").iloc(10, 25)[["o_orderkey"]])
query("head", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7")(lambda get: get("orders").head(7)[["o_orderkey"]])
query("tail", "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 7")(lambda get: get("orders").tail(7)[["o_orderkey"]])
query("take", "SELECT o_orderkey FROM orders QUALIFY row_number() OVER (ORDER BY o_orderkey) - 1 IN (3, 5, 100)")(lambda get: get("orders").take([3, 5, 100])[["o_orderkey"]])
query("reset_index_row_numbers", "SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events")(lambda get: get("events").with_row_number("i")[["event_id", "i"]])
query("xs", "SELECT turn, role FROM conversations WHERE conv_id = 3")(lambda get: get("conversations").xs(3)[["turn", "role"]])
query("truncate", "SELECT o_orderkey FROM orders WHERE o_orderkey >= 14000")(lambda get: get("orders").truncate(before=14000)[["o_orderkey"]])
query("sample")(lambda get: get("orders").sample(0.1, seed=3)[["o_orderkey"]])
query("add_prefix", "SELECT r_regionkey AS x_r_regionkey, r_name AS x_r_name FROM region")(lambda get: get("region").add_prefix("x_"))
query("add_suffix", "SELECT r_regionkey AS r_regionkey_x, r_name AS r_name_x FROM region")(lambda get: get("region").add_suffix("_x"))
query("rename", "SELECT r_regionkey AS k, r_name FROM region")(lambda get: get("region").rename({"r_regionkey": "k"}))
query("set_axis", "SELECT r_regionkey AS a, r_name AS b FROM region")(lambda get: get("region").set_axis(["a", "b"]))
query("insert", "SELECT r_regionkey, length(r_name) AS n, r_name FROM region")(lambda get: (lambda f: f.insert(1, "n", f["r_name"].str.len()))(get("region")))
query("drop", "SELECT n_nationkey, n_regionkey FROM nation")(lambda get: get("nation").drop("n_name"))
query("filter_names", "SELECT o_orderkey, o_orderstatus, o_orderdate, o_orderpriority FROM orders")(lambda get: get("orders").filter(regex="^o_order"))
query("select_dtypes", "SELECT c_custkey FROM customer")(lambda get: get("customer").select_dtypes("bigint"))
query("reindex", "SELECT r_name, 0 AS extra FROM region")(lambda get: get("region").reindex(["r_name", "extra"], 0))
query("setitem_where", "SELECT o_orderkey, CASE WHEN o_custkey < 500 THEN o_totalprice ELSE 0 END AS o_totalprice FROM orders")(lambda get: (lambda f: f.where(f["o_custkey"] < 500, 0.0, ["o_totalprice"])[["o_orderkey", "o_totalprice"]])(get("orders")))
query("mask_frame", "SELECT o_orderkey, CASE WHEN o_custkey < 500 THEN NULL ELSE o_totalprice END AS o_totalprice FROM orders")(lambda get: (lambda f: f.mask(f["o_custkey"] < 500, None, ["o_totalprice"])[["o_orderkey", "o_totalprice"]])(get("orders")))
query("droplevel", "SELECT turn, role FROM conversations")(lambda get: get("conversations").droplevel(0)[["turn", "role"]])
query("swaplevel", "SELECT turn, conv_id FROM conversations")(lambda get: (lambda f: f[f.index])(get("conversations").swaplevel()))

# ---- order
query("sort_values_top", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")(lambda get: get("orders").sort_values(["o_totalprice", "o_orderkey"], [False, True]).df.limit(20).select("o_orderkey", "o_totalprice"))
query("sort_index", "SELECT o_orderkey FROM orders")(lambda get: get("orders").sort_index(ascending=False)[["o_orderkey"]])
query("nlargest", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")(lambda get: get("orders").nlargest(10, "o_totalprice")[["o_orderkey"]])
query("nsmallest", "SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10")(lambda get: get("orders").nsmallest(10, "o_totalprice")[["o_orderkey"]])

# ---- shape
query("melt", "SELECT p_partkey, 'p_size' AS variable, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")(lambda get: get("part").astype({"p_size": "double"}).melt(["p_partkey"], ["p_size", "p_retailprice"]))
query("pivot_table", "SELECT event_type, round(avg(value) FILTER (user_id % 3 = 0), 4) AS \"0\", round(avg(value) FILTER (user_id % 3 = 1), 4) AS \"1\", round(avg(value) FILTER (user_id % 3 = 2), 4) AS \"2\" FROM events GROUP BY ALL")(lambda get: rounded(get("events").assign(k=F.col("user_id") % 3).pivot_table("event_type", "k", "value", "mean", [0, 1, 2]).df))
query("pivot_table_margins", "SELECT l_returnflag, sum(l_quantity) FILTER (l_linestatus = 'F') AS \"F\", sum(l_quantity) FILTER (l_linestatus = 'O') AS \"O\", sum(l_quantity) AS \"All\" FROM lineitem GROUP BY ALL")(lambda get: get("lineitem").df.transform(lambda d: R.pivot_table(d, ["l_returnflag"], "l_linestatus", "l_quantity", "sum", ["F", "O"], True)))
query("pivot", "SELECT conv_id, max(text) FILTER (turn = 0) AS \"0\", max(text) FILTER (turn = 1) AS \"1\" FROM conversations GROUP BY ALL")(lambda get: get("conversations").pivot("conv_id", "turn", "text", [0, 1]))
query("stack", "SELECT p_partkey, 'p_size' AS level, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")(lambda get: get("part").astype({"p_size": "double"}).stack(["p_size", "p_retailprice"]))
query("unstack", "SELECT conv_id, max(role) FILTER (turn = 0) AS \"0\", max(role) FILTER (turn = 1) AS \"1\" FROM conversations GROUP BY ALL")(lambda get: get("conversations").unstack("turn", "role", [0, 1]))
query("crosstab", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY ALL")(lambda get: R.crosstab(get("orders").df, "o_orderpriority", "o_orderstatus", ["F", "O", "P"]))
query("get_dummies", "SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INT) AS s_F, CAST(o_orderstatus = 'O' AS INT) AS s_O, CAST(o_orderstatus = 'P' AS INT) AS s_P FROM orders")(lambda get: get("orders")[["o_orderkey", "o_orderstatus"]].get_dummies("o_orderstatus", prefix="s"))
query("factorize", "SELECT event_id, CAST(dense_rank() OVER (ORDER BY f) - 1 AS BIGINT) AS code FROM (SELECT event_id, min(event_id) OVER (PARTITION BY event_type) AS f FROM events)")(lambda get: get("events").factorize("event_type").df.select("event_id", F.col("code").cast("bigint").alias("code")))
query("qcut", "SELECT event_id, CAST(value > q[1] AS INT) + CAST(value > q[2] AS INT) + CAST(value > q[3] AS INT) AS bucket FROM events, (SELECT quantile_cont(value, [0.25, 0.5, 0.75]) AS q FROM events)")(lambda get: get("events").qcut("value", 4)[["event_id", "bucket"]])
query("transpose", "SELECT 'n' AS \"key\", count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'P') AS \"P\" FROM orders")(lambda get: get("orders").groupby("o_orderstatus").agg(n=("o_orderkey", "size")).transpose("o_orderstatus"))
query("explode", "SELECT vec_id, unnest(embedding) AS embedding FROM embeddings")(lambda get: get("embeddings")[["vec_id", "embedding"]].explode("embedding"))
query("repeat", "SELECT n_nationkey FROM nation, range(3)")(lambda get: get("nation").repeat(3)[["n_nationkey"]])

# ---- statistics
query("corr", "SELECT a, b, round(corr, 6) AS corr FROM (SELECT 'l_quantity' AS a, 'l_quantity' AS b, 1.0 AS corr UNION ALL SELECT 'l_quantity', 'l_extendedprice', corr(l_quantity, l_extendedprice) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_quantity', corr(l_quantity, l_extendedprice) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_extendedprice', 1.0)")(lambda get: rounded(get("lineitem").corr([Q, V]).df, 6))
query("cov", "SELECT 'l_quantity' AS a, 'l_discount' AS b, round(covar_samp(l_quantity, l_discount), 6) AS cov FROM lineitem")(lambda get: rounded(get("lineitem").cov([Q, "l_discount"]).df.where("a = 'l_quantity' and b = 'l_discount'"), 6))
query("corrwith", "SELECT round(corr(l_extendedprice, l_quantity), 6) AS l_extendedprice, round(corr(l_discount, l_quantity), 6) AS l_discount FROM lineitem")(lambda get: rounded(get("lineitem").corrwith(Q, [V, "l_discount"]).df, 6))
query("autocorr", "SELECT round(corr(value, b), 6) AS value FROM (SELECT value, lag(value) OVER (ORDER BY event_id) AS b FROM events)")(lambda get: rounded(get("events")["value"].autocorr().df, 6))

# ---- missing data, duplicates
_nul = lambda get: get("orders").assign(o_orderstatus=F.expr("nullif(o_orderstatus, 'P')"), o_custkey=F.expr("nullif(o_custkey % 5, 0)"))
query("dropna_any", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND o_custkey % 5 <> 0")(lambda get: _nul(get).dropna()[["o_orderkey"]])
query("dropna_all", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' OR o_custkey % 5 <> 0")(lambda get: _nul(get).dropna("all", subset=["o_orderstatus", "o_custkey"])[["o_orderkey"]])
query("dropna_thresh", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND o_custkey % 5 <> 0")(lambda get: _nul(get).dropna(thresh=2, subset=["o_orderstatus", "o_custkey"])[["o_orderkey"]])
query("fillna_frame", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'P'), '-') AS o_orderstatus, coalesce(nullif(o_custkey % 5, 0), -1) AS o_custkey FROM orders")(lambda get: _nul(get).fillna({"o_orderstatus": "-", "o_custkey": -1})[["o_orderkey", "o_orderstatus", "o_custkey"]])
query("isna_frame", "SELECT o_orderkey, o_orderstatus = 'P' AS o_orderstatus FROM orders")(lambda get: _nul(get).isna(["o_orderstatus"]))
query("first_valid_index", "SELECT min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus <> 'P'")(lambda get: _nul(get).first_valid_index("o_orderstatus"))
query("last_valid_index", "SELECT max(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus <> 'P'")(lambda get: _nul(get).last_valid_index("o_orderstatus"))
query("drop_duplicates_first", "SELECT min(event_id) AS event_id FROM events GROUP BY user_id, event_type")(lambda get: get("events").drop_duplicates(["user_id", "event_type"])[["event_id"]])
query("drop_duplicates_last", "SELECT max(event_id) AS event_id FROM events GROUP BY user_id, event_type")(lambda get: get("events").drop_duplicates(["user_id", "event_type"], "last")[["event_id"]])
query("drop_duplicates_none", "SELECT event_id FROM events QUALIFY count(*) OVER (PARTITION BY user_id, event_type) = 1")(lambda get: get("events").drop_duplicates(["user_id", "event_type"], False)[["event_id"]])
query("duplicated", "SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS duplicated FROM documents")(lambda get: get("documents").duplicated(["text"])[["doc_id", "duplicated"]])
query("at_time", "SELECT event_id FROM events WHERE strftime(ts, '%H:%M:%S') = '00:00:07'")(lambda get: get("events").at_time("ts", "00:00:07")[["event_id"]])
query("between_time", "SELECT event_id FROM events WHERE strftime(ts, '%H:%M:%S') BETWEEN '09:00:00' AND '17:00:00'")(lambda get: get("events").between_time("ts", "09:00:00", "17:00:00")[["event_id"]])


# ---- flows of user code
def _words(row: dict):
    for w in (row["text"] or "").split():
        yield {"word": w, "n": 1}


def _sums(batch: pd.DataFrame) -> pd.DataFrame:
    return batch.groupby("word", as_index=False).n.sum()


_wc = "SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) AS w FROM benchmark) GROUP BY ALL"
query("map_reduce_word_count", _wc)(lambda get: get("benchmark").mf.map_reduce(lambda b: pd.DataFrame([w for t in b.text for w in _words({"text": t})], columns=["word", "n"]), _sums, ["word"], "word string, n bigint", "word string, n bigint", combiner=_sums, whole_groups=True))
query("flatmap_word_count", _wc)(lambda get: get("benchmark").mf.flatmap(_words, "word string, n bigint").df.groupBy("word").agg(F.sum("n").alias("n")))
query("apply_chunk", "SELECT event_id, round(value * 2, 4) AS r FROM events")(lambda get: rounded(get("events").mf.apply_chunk(lambda p: pd.DataFrame({"event_id": p.event_id, "r": p.value * 2}), "event_id bigint, r double", 500).df))
query("cartesian_chunk", "SELECT n_nationkey, r_regionkey FROM nation, region WHERE n_nationkey % 5 <> r_regionkey")(lambda get: get("nation").mf.cartesian_chunk(get("region"), lambda a, b: a.merge(b, how="cross").query("n_nationkey % 5 != r_regionkey")[["n_nationkey", "r_regionkey"]], "n_nationkey int, r_regionkey int", 2))
query("reshuffle", "SELECT user_id, event_id FROM events")(lambda get: get("events").mf.reshuffle(["user_id"], ["event_id"])[["user_id", "event_id"]])
query("rebalance", "SELECT event_id FROM events")(lambda get: get("events").mf.rebalance(num_partitions=4)[["event_id"]])
query("mf_flatjson", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")(lambda get: get("events").mf.flatjson("props", {"k": "$.k"}, {"k": "int"})[["event_id", "k"]])
query("mf_collect_extract_kv", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS p_size FROM part")(lambda get: get("part").mf.collect_kv(["p_size", "p_type"]).drop(["p_size", "p_type"]).mf.extract_kv("kv", ["p_size"])[["p_partkey", "p_size"]])
