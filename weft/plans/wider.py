"""Queries of missing values as NaN, index-free expressions, scores, grouped flows, arrays from shapes and transforms."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..frame import Frame, Series
from ..functions import numeric as U
from ..lite import LiteFrame
from ..operators import learn as M
from ..operators import models as O
from ..operators import reshape as R
from ..operators import tensor as X
from ..operators.tensor import Tensor
from .registry import column, query, rounded

# ---- NaN is missing
_nan = lambda get: get("events").assign(x=F.when(F.col("value") < 10, F.lit(float("nan"))).otherwise(F.col("value")))
_N = "(SELECT *, CASE WHEN value >= 10 THEN value END AS x FROM events)"
for how, sql in {"count": "count(x)", "sum": "sum(x)", "mean": "avg(x)", "min": "min(x)", "max": "max(x)", "median": "median(x)", "std": "stddev_samp(x)", "nunique": "count(DISTINCT x)", "size": "count(*)"}.items():
    query(f"nan_reduce_{how}", f"SELECT round(CAST({sql} AS DOUBLE), 4) AS r FROM {_N}")(lambda get, how=how: rounded(_nan(get).agg(r=("x", how)).df.withColumn("r", F.col("r").cast("double"))))
    query(f"nan_groupby_{how}", f"SELECT event_type, round(CAST({sql} AS DOUBLE), 4) AS r FROM {_N} GROUP BY ALL")(lambda get, how=how: rounded(_nan(get).groupby("event_type").agg(r=("x", how)).df.withColumn("r", F.col("r").cast("double"))))
query("nan_groupby_first", f"SELECT user_id, arg_min(x, event_id) AS r FROM {_N} GROUP BY ALL")(lambda get: _nan(get).groupby("user_id").agg(r=("x", "first")))
query("nan_groupby_idxmax", f"SELECT user_id, arg_min(event_id, (-x, event_id)) FILTER (x IS NOT NULL) AS r FROM {_N} GROUP BY ALL")(lambda get: _nan(get).groupby("user_id").agg(r=("x", "idxmax")))
query("nan_idxmax_time", "SELECT user_id, arg_min(event_id, (-epoch_us(ts), event_id)) AS r FROM events GROUP BY ALL")(lambda get: get("events").groupby("user_id").agg(r=("ts", "idxmax")))
query("nan_isna", f"SELECT event_id, x IS NULL AS x FROM {_N}")(lambda get: _nan(get).isna(["x"]))
query("nan_fillna", f"SELECT event_id, coalesce(x, -1) AS r FROM {_N}")(lambda get: (lambda f: f.df.select("event_id", f["x"].fillna(-1.0).column.alias("r")))(_nan(get)))
query("nan_dropna", f"SELECT event_id FROM {_N} WHERE x IS NOT NULL")(lambda get: _nan(get).dropna(subset=["x"])[["event_id"]])
query("nan_compare", f"SELECT event_id, coalesce(x > 20, false) AS gt, coalesce(x <> 20, true) AS ne, coalesce(x = x, false) AS eq FROM {_N}")(lambda get: (lambda f: f.df.select("event_id", (f["x"] > 20).column.alias("gt"), (f["x"] != 20).column.alias("ne"), (f["x"] == f["x"]).column.alias("eq")))(_nan(get)))
query("nan_groupby_cumsum", f"SELECT event_id, round(CASE WHEN x IS NOT NULL THEN sum(x) OVER (PARTITION BY user_id ORDER BY event_id) END, 4) AS r FROM {_N}")(lambda get: rounded(_nan(get).groupby("user_id").cumsum("x", "r").df.select("event_id", "r")))
query("nan_groupby_ffill", f"SELECT event_id, last_value(x IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM {_N}")(lambda get: _nan(get).groupby("user_id").ffill("x", "r")[["event_id", "r"]])
query("nan_value_counts", f"SELECT CAST(floor(x / 10) AS DOUBLE) AS b, count(*) AS count FROM {_N} WHERE x IS NOT NULL GROUP BY ALL")(lambda get: _nan(get).assign(b=F.expr("if(isnan(x), x, cast(floor(x / 10) as double))"))["b"].value_counts())
query("nan_describe", f"SELECT 'x' AS \"column\", CAST(count(x) AS DOUBLE) AS count, round(avg(x), 3) AS mean, round(stddev_samp(x), 3) AS std, min(x) AS min, round(quantile_cont(x, 0.25), 3) AS q25, round(median(x), 3) AS median, round(quantile_cont(x, 0.75), 3) AS q75, max(x) AS max FROM {_N}")(lambda get: rounded(_nan(get).describe(["x"]).df, 3))
query("query_literal", "SELECT o_orderkey, o_orderpriority || '==' AS t FROM orders WHERE o_orderpriority || '==' = '1-URGENT==' AND o_orderstatus <> 'F'")(lambda get: get("orders").assign(t=F.concat("o_orderpriority", F.lit("=="))).query("t == '1-URGENT==' and o_orderstatus != 'F'")[["o_orderkey", "t"]])

# ---- grouped flows
_W = "SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) AS w FROM documents) GROUP BY ALL"


def _count(batch: pd.DataFrame) -> pd.DataFrame:
    """Words of a batch of texts with their counts."""
    words = batch.text.dropna().str.findall(r"[^ \t\n\x0b\f\r]+").explode().dropna()
    return words.value_counts().rename_axis("word").reset_index(name="n").astype({"n": "int64"})


def _sums(batch: pd.DataFrame) -> pd.DataFrame:
    return batch.groupby("word", as_index=False).n.sum()


class _Spread:
    """Range of a group's values, and whether they came in order."""

    def __init__(self) -> None:
        self.first = self.last = None
        self.rising = True

    def __call__(self, batch: pd.DataFrame, end: bool = False):
        ids = batch.event_id.tolist()
        self.rising &= ids == sorted(ids) and (self.last is None or self.last < ids[0])
        self.first = ids[0] if self.first is None else self.first
        self.last = ids[-1]
        if end:
            return pd.DataFrame({"user_id": [batch.user_id.iloc[0]], "first": [self.first], "last": [self.last], "rising": [self.rising]})


query("map_reduce_documents", _W)(lambda get: get("documents").mf.map_reduce(_count, _sums, ["word"], "word string, n bigint", "word string, n bigint", combiner=_sums, whole_groups=True))
query("groupby_apply_chunk", "SELECT user_id, min(event_id) AS first, max(event_id) AS last, true AS rising FROM events GROUP BY ALL")(lambda get: get("events")[["user_id", "event_id"]].groupby("user_id").mf.apply_chunk(_Spread, "user_id bigint, first bigint, last bigint, rising boolean", 3, order_cols=["event_id"]))
query("groupby_apply_chunk_desc", "SELECT user_id, arg_max(value, event_id) AS r FROM events GROUP BY ALL")(lambda get: get("events")[["user_id", "event_id", "value"]].groupby("user_id").mf.apply_chunk(lambda p: pd.DataFrame({"user_id": p.user_id[:1], "r": p.value[:1]}), "user_id bigint, r double", order_cols=["event_id"], ascending=False))

# ---- index-free frames
_O = lambda get: LiteFrame(get("orders").df)
for name, sql, make in [
    ("floordiv", "floor(o_totalprice / 7)", lambda o: o["O_TOTALPRICE"] // 7.0), ("rfloordiv", "floor(1e7 / o_totalprice)", lambda o: 1e7 // o["o_totalprice"]), ("mod", "o_custkey % 7", lambda o: o["o_custkey"] % 7),
    ("rmod", "1000 % nullif(o_custkey, 0)", lambda o: 1000 % o["o_custkey"]), ("rpow", "pow(2.0, o_custkey % 5)", lambda o: 2.0 ** (o["o_custkey"] % 5)), ("sqrt", "sqrt(o_totalprice)", lambda o: o["o_totalprice"].sqrt()),
    ("where", "CASE WHEN o_custkey > 100 THEN o_totalprice ELSE 0 END", lambda o: o["o_totalprice"].where(o["o_custkey"] > 100, 0.0)), ("xor", "CAST((o_custkey > 100) <> (o_totalprice > 2e5) AS INT)", lambda o: ((o["o_custkey"] > 100) ^ (o["o_totalprice"] > 2e5)).astype("int")),
    ("str", "length(upper(o_orderpriority))", lambda o: o["o_orderpriority"].str.upper().str.len()), ("dt", "month(o_orderdate)", lambda o: o["o_orderdate"].dt.month()), ("fillna", "coalesce(nullif(o_custkey % 5, 0), -1)", lambda o: o["o_custkey"].astype("double").mask(o["o_custkey"] % 5 == 0).astype("double").fillna(-1.0).where(o["o_custkey"] % 5 == 0, 0) + (o["o_custkey"] % 5)),
]:
    query(f"lite_{name}", f"SELECT o_orderkey, round(CAST({sql} AS DOUBLE), 6) AS r FROM orders")(lambda get, make=make: (lambda o: o.select("o_orderkey", F.round(make(o).column.cast("double"), 6).alias("r")).df)(_O(get)))
query("lite_dict", "SELECT o_orderkey, o_custkey AS a, CAST(NULL AS BIGINT) AS b, 1 AS n FROM orders")(lambda get: (lambda o: o.select("o_orderkey", o["m"].dict["k"].alias("a"), o["m"].dict.get("z").alias("b"), o["m"].dict.len().alias("n")).df)(_O(get).assign(m=F.create_map(F.lit("k"), F.col("o_custkey")))))
query("lite_list", "SELECT vec_id, round(CAST(embedding[3] AS DOUBLE), 6) AS x, 64 AS n FROM embeddings")(lambda get: rounded((lambda e: e.select("vec_id", e["embedding"].list[2].astype("double").alias("x"), e["embedding"].list.len().alias("n")).df)(LiteFrame(get("embeddings").df)), 6))
query("lite_struct", "SELECT o_orderkey, o_custkey AS a FROM orders")(lambda get: (lambda o: o.select("o_orderkey", o["s"].struct.field("x", "y").alias("a")).df)(_O(get).assign(s=F.struct(F.struct(F.col("o_custkey").alias("y")).alias("x")))))


def _set(get):
    o = _O(get)
    o["Double_Price"] = o["o_totalprice"] * 2
    return o.iloc([0, -1]).df


query("lite_setitem_iloc", "SELECT o_orderkey, o_totalprice * 2 AS double_price FROM orders")(_set)
query("lite_set_iloc", "SELECT r_regionkey * 10 AS r_regionkey, r_name FROM region")(lambda get: (lambda r: r.set_iloc(0, r["r_regionkey"] * 10).df)(LiteFrame(get("region").df)))
query("lite_replace", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' ELSE o_orderstatus END AS o_orderstatus FROM orders")(lambda get: _O(get).replace({"F": "done"}, ["O_ORDERSTATUS"]).select("o_orderkey", "o_orderstatus").df)
query("lite_concat", "SELECT c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")(lambda get: LiteFrame(get("customer").df.selectExpr("c_custkey k", "c_name name")).concat(LiteFrame(get("supplier").df.selectExpr("s_suppkey k", "s_name name"))).df)
for how, sql in {"sum": "sum({c})", "mean": "avg({c})", "min": "min({c})", "max": "max({c})", "count": "count({c})", "size": "count(*)", "var": "var_samp({c})", "std": "stddev_samp({c})", "sem": "stddev_samp({c}) / sqrt(count({c}))", "skew": "skewness({c})", "kurt": "kurtosis({c})", "nunique": "count(DISTINCT {c})", "median": "median({c})"}.items():
    query(f"lite_reduce_{how}", f"SELECT round(CAST({sql.format(c='l_quantity')} AS DOUBLE), 4) AS l_quantity FROM lineitem")(lambda get, how=how: rounded(getattr(LiteFrame(get("lineitem").df), how)("L_QUANTITY").df.withColumn("l_quantity", F.col("l_quantity").cast("double"))))
    query(f"lite_groupby_{how}", f"SELECT l_returnflag, round(CAST({sql.format(c='l_quantity')} AS DOUBLE), 4) AS l_quantity FROM lineitem GROUP BY ALL")(lambda get, how=how: rounded(getattr(LiteFrame(get("lineitem").df).groupby("l_returnflag"), how)("L_QUANTITY").df.withColumn("l_quantity", F.col("l_quantity").cast("double"))))
for how, sql in {"any": "bool_or(value > 100)", "all": "bool_and(value >= 0)"}.items():
    query(f"lite_reduce_{how}", f"SELECT {sql} AS b FROM events")(lambda get, how=how: (lambda e: getattr(e.assign(b=e["value"] > 100 if how == "any" else e["value"] >= 0), how)("b").df)(LiteFrame(get("events").df)))
query("lite_reduce_prod", "SELECT round(product(1 + o_custkey % 3 / 1e6), 8) AS x FROM orders")(lambda get: rounded((lambda o: o.assign(x=(o["o_custkey"] % 3) / 1e6 + 1).prod("x").df)(_O(get)), 8))

# ---- scores: the part's brand guessed from its size
_G = lambda get: get("part").df.selectExpr("p_size % 3 as t", "(p_size + p_partkey % 2) % 3 as p")
_P = "(SELECT p_size % 3 AS t, (p_size + p_partkey % 2) % 3 AS p FROM part)"
_E = f"(SELECT l AS label, count(*) FILTER (t = l AND p = l) AS tp, count(*) FILTER (t <> l AND p = l) AS fp, count(*) FILTER (t = l AND p <> l) AS fn, count(*) FILTER (t <> l AND p <> l) AS tn FROM {_P}, (SELECT unnest([0, 1, 2]) AS l) GROUP BY l)"
query("learn_multilabel_confusion", f"SELECT label, tn, fp, fn, tp FROM {_E}")(lambda get: M.multilabel_confusion(_G(get), "t", "p"))
for name, f, sql in [("precision", M.precision_score, "tp / (tp + fp)"), ("recall", M.recall_score, "tp / (tp + fn)"), ("f1", M.f1_score, "2 * tp / (2 * tp + fp + fn)")]:
    out = "fscore" if name == "f1" else name
    query(f"learn_{name}_binary", f"SELECT round({sql}, 8) AS {out} FROM {_E} WHERE label = 1")(lambda get, f=f: rounded(f(_G(get), "t", "p"), 8))
    query(f"learn_{name}_macro", f"SELECT round(avg({sql}), 8) AS {out} FROM {_E}")(lambda get, f=f: rounded(f(_G(get), "t", "p", "macro"), 8))
    query(f"learn_{name}_micro", f"SELECT round({sql}, 8) AS {out} FROM (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM {_E})")(lambda get, f=f: rounded(f(_G(get), "t", "p", "micro"), 8))
    query(f"learn_{name}_weighted", f"SELECT round(sum({sql} * (tp + fn)) / sum(tp + fn), 8) AS {out} FROM {_E}")(lambda get, f=f: rounded(M.get_scorer(f"{name}_weighted")(_G(get), "t", "p") if name == "f1" else f(_G(get), "t", "p", "weighted"), 8))
query("learn_fbeta", f"SELECT round(5 * tp / (5 * tp + 4 * fn + fp), 8) AS fscore FROM {_E} WHERE label = 1")(lambda get: rounded(M.fbeta_score(_G(get), "t", "p", 2.0), 8))
query("learn_unique_labels", f"SELECT DISTINCT t AS label FROM {_P}")(lambda get: M.unique_labels(_G(get).select("t"), _G(get).select("p")))
query("learn_one_hot", "SELECT o_orderkey, [CAST(o_orderstatus = 'F' AS DOUBLE), CAST(o_orderstatus = 'O' AS DOUBLE), CAST(o_orderstatus = 'P' AS DOUBLE)]::VARCHAR AS onehot FROM orders")(lambda get: (lambda d: M.one_hot(d, M.categories(d, ["o_orderstatus"])).select("o_orderkey", F.concat(F.lit("["), F.array_join(F.transform("onehot", lambda x: x.cast("string")), ", "), F.lit("]")).alias("onehot")))(get("orders").df))
query("learn_scale", "SELECT o_orderkey, round(o_totalprice - (SELECT avg(o_totalprice) FROM orders), 4) AS o_totalprice FROM orders")(lambda get: rounded(M.scale(get("orders").df.select("o_orderkey", "o_totalprice"), ["o_totalprice"], with_std=False)))
query("learn_row_norms", "SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS norm FROM embeddings")(lambda get: rounded(M.row_norms(get("embeddings").df, "embedding", True).select("vec_id", "norm"), 6))

# ---- arrays
_T = lambda get: Tensor.from_vectors(get("embeddings").df, "vec_id", "embedding")
_A = "(SELECT vec_id AS i0, CAST(unnest(range(64)) AS INT) AS i1, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
_S = lambda get: get("region").df.sparkSession
query("tensor_zeros", "SELECT a.range AS i0, CAST(b.range AS INT) AS i1, 0.0::DOUBLE AS v FROM range(4) a, range(3) b")(lambda get: X.zeros(_S(get), (4, 3)).df)
query("tensor_ones_like", f"SELECT i0, i1, 1.0::DOUBLE AS v FROM {_A}")(lambda get: X.ones_like(_T(get)).df)
query("tensor_identity", "SELECT range AS i0, range AS i1, 1.0::DOUBLE AS v FROM range(5)")(lambda get: X.identity(_S(get), 5).df)
query("tensor_indices", "SELECT CAST(k AS INT) AS i0, a.range AS i1, CAST(b.range AS INT) AS i2, CAST(CASE k WHEN 0 THEN a.range ELSE b.range END AS DOUBLE) AS v FROM range(4) a, range(3) b, (SELECT unnest([0, 1]) AS k)")(lambda get: X.indices(_S(get), (4, 3)).df)
query("tensor_meshgrid", "SELECT y.range AS i0, x.range AS i1, CAST(x.range AS DOUBLE) AS v FROM range(3) x, range(4) y")(lambda get: X.meshgrid(Tensor.arange(_S(get), 3), Tensor.arange(_S(get), 4))[0].df)
query("tensor_from_columns", "SELECT p_partkey AS i0, 0 AS i1, CAST(p_size AS DOUBLE) AS v FROM part UNION ALL SELECT p_partkey, 1, p_retailprice FROM part")(lambda get: X.from_columns(get("part").df, "p_partkey", ["p_size", "p_retailprice"]).df)
query("tensor_to_columns", "SELECT p_partkey AS i0, CAST(p_size AS DOUBLE) AS a, p_retailprice AS b FROM part")(lambda get: X.to_columns(X.from_columns(get("part").df, "p_partkey", ["p_size", "p_retailprice"]), ["a", "b"]))
query("tensor_hstack", f"SELECT i0, i1, round(v, 6) AS v FROM {_A} UNION ALL SELECT i0, i1 + 64, round(v * 2, 6) FROM {_A}")(lambda get: (lambda t: rounded(X.hstack([t, t * 2.0], [64]).df, 6))(_T(get)))
query("tensor_column_stack", f"SELECT i0, 0 AS i1, round(v, 6) AS v FROM {_A} WHERE i1 = 0 UNION ALL SELECT i0, 1, round(v, 6) FROM {_A} WHERE i1 = 5")(lambda get: (lambda t: rounded(X.column_stack([t.slice(1, 0, 1).squeeze(1), t.slice(1, 5, 6).squeeze(1)]).df, 6))(_T(get)))
query("tensor_dstack", "SELECT a.range AS i0, CAST(b.range AS INT) AS i1, CAST(k AS INT) AS i2, CAST(k AS DOUBLE) AS v FROM range(2) a, range(3) b, (SELECT unnest([0, 1]) AS k)")(lambda get: X.dstack([X.zeros(_S(get), (2, 3)), X.ones(_S(get), (2, 3))], [1]).df)
query("tensor_array_split", f"SELECT i0, CAST(i1 - 22 AS BIGINT) AS i1, round(v, 6) AS v FROM {_A} WHERE i1 BETWEEN 22 AND 42")(lambda get: rounded(X.array_split(_T(get), 3, 1, 64)[1].df, 6))
query("tensor_broadcast_to", "SELECT CAST(a.range AS INT) AS i0, b.range AS i1, CAST(b.range AS DOUBLE) AS v FROM range(3) a, range(4) b")(lambda get: X.broadcast_to(Tensor.arange(_S(get), 4), (4,), (3, 4)).df)
query("tensor_fliplr", f"SELECT i0, 63 - i1 AS i1, round(v, 6) AS v FROM {_A}")(lambda get: rounded(X.fliplr(_T(get), 64).df, 6))
query("tensor_argwhere", f"SELECT i0, i1 FROM {_A} WHERE v > 0.2")(lambda get: X.argwhere(_T(get).map(lambda v: (v > 0.2).cast("double"))))
query("tensor_shape", f"SELECT max(i0) + 1 AS i0, CAST(max(i1) + 1 AS BIGINT) AS i1 FROM {_A}")(lambda get: X.shape(_T(get)))
query("tensor_choose", f"SELECT i0, i1, round(CASE WHEN v > 0 THEN v * 2 ELSE v END, 6) AS v FROM {_A}")(lambda get: (lambda t: rounded(X.choose(t.map(lambda v: (v > 0).cast("double")), [t, t * 2.0]).df, 6))(_T(get)))
query("tensor_unravel_index", "SELECT event_id, event_id // 20 % 7 AS a, event_id // 5 % 4 AS b, event_id % 5 AS c FROM events")(lambda get: get("events").df.select("event_id", *[c.cast("bigint").alias(n) for c, n in zip(X.unravel_index(F.col("event_id"), (7, 4, 5)), "abc")]))
_Z = lambda get: _T(get).map(lambda v: F.when(v > 0.1, F.lit(float("nan"))).otherwise(v))
for how, sql in {"sum": "sum(v)", "mean": "avg(v)", "min": "min(v)", "max": "max(v)", "var": "var_pop(v)", "std": "stddev_pop(v)", "prod": "product(v)"}.items():
    query(f"tensor_nan{how}", f"SELECT i1 AS i0, round({sql}, 6) + 0.0 AS v FROM {_A} WHERE v <= 0.1 GROUP BY i1")(lambda get, how=how: rounded(X.nan_reduce(_Z(get), how, 0).df, 6).withColumn("v", F.col("v") + 0.0))
query("tensor_nanargmax", f"SELECT i1 AS i0, CAST(arg_max(i0, (v, -i0)) AS DOUBLE) AS v FROM {_A} WHERE v <= 0.1 GROUP BY i1")(lambda get: X.nan_arg(_Z(get), "max", 0).df)
query("tensor_nancumsum", f"SELECT i0, i1, round(sum(CASE WHEN v > 0.1 THEN 0 ELSE v END) OVER (PARTITION BY i0 ORDER BY i1), 6) AS v FROM {_A}")(lambda get: rounded(X.nan_cum(_Z(get), "sum", 1).df, 6))
query("tensor_tensordot", f"SELECT a.i1 AS i0, b.i1, round(sum(a.v * b.v), 6) AS v FROM {_A} a JOIN {_A} b USING (i0) GROUP BY a.i1, b.i1")(lambda get: rounded(X.tensordot(_T(get), _T(get), ([0], [0])).df, 6))
query("tensor_vector_norm", f"SELECT i0, round(pow(sum(pow(abs(v), 3)), 1 / 3.0), 6) AS v FROM {_A} GROUP BY i0")(lambda get: rounded(X.vector_norm(_T(get), 3, 1).df, 6))
query("tensor_matrix_norm", f"SELECT round(max(s), 6) AS v FROM (SELECT sum(abs(v)) AS s FROM {_A} GROUP BY i1)")(lambda get: rounded(X.matrix_norm(_T(get), 1).df, 6))
_few = lambda get: Tensor(_T(get).slice(1, 0, 5).transpose().df, 2)
_F5 = f"(SELECT i1 AS i0, i0 AS i1, v FROM {_A} WHERE i1 < 5)"
query("tensor_cdist", f"SELECT CAST(a.i0 AS BIGINT) AS i0, CAST(b.i0 AS BIGINT) AS i1, round(sqrt(sum(pow(a.v - b.v, 2))), 6) AS v FROM {_F5} a JOIN {_F5} b USING (i1) GROUP BY ALL")(lambda get: rounded(X.cdist(_few(get), _few(get)).df, 6))
query("tensor_pdist", f"SELECT CAST(row_number() OVER (ORDER BY i, j) - 1 AS BIGINT) AS i0, v FROM (SELECT a.i0 AS i, b.i0 AS j, round(sqrt(sum(pow(a.v - b.v, 2))), 6) AS v FROM {_F5} a JOIN {_F5} b USING (i1) WHERE a.i0 < b.i0 GROUP BY ALL)")(lambda get: rounded(X.pdist(_few(get), 5).df, 6))
query("tensor_squareform", f"SELECT CAST(a.i0 AS BIGINT) AS i0, CAST(b.i0 AS BIGINT) AS i1, round(sum(abs(a.v - b.v)), 6) AS v FROM {_F5} a JOIN {_F5} b USING (i1) WHERE a.i0 <> b.i0 GROUP BY ALL")(lambda get: rounded(X.squareform(X.pdist(_few(get), 5, "cityblock"), 5).df, 6))
query("tensor_digitize", "SELECT event_id, CAST(value >= 5 AS INT) + CAST(value >= 20 AS INT) + CAST(value >= 50 AS INT) AS r FROM events")(lambda get: get("events").df.select("event_id", X.digitize(F.col("value"), [5, 20, 50]).alias("r")))

# ---- transforms
_turn = "2 * pi() * i1 * f / 64"
query("tensor_fft", f"SELECT i0, CAST(f AS INT) AS i1, round(sum(v * cos({_turn})), 5) + 0.0 AS v FROM {_A}, (SELECT unnest(range(64)) AS f) GROUP BY ALL")(lambda get: rounded(X.fft(_T(get), 1, 64)[0].df, 5).withColumn("v", F.col("v") + 0.0))
query("tensor_rfft", f"SELECT i0, CAST(f AS BIGINT) AS i1, round(-sum(v * sin({_turn})), 5) + 0.0 AS v FROM {_A}, (SELECT unnest(range(33)) AS f) GROUP BY ALL")(lambda get: rounded(X.rfft(_T(get), 1, 64)[1].df, 5).withColumn("v", F.col("v") + 0.0))
query("tensor_ifft", f"SELECT i0, i1, round(v, 5) + 0.0 AS v FROM {_A}")(lambda get: rounded(X.ifft(*X.fft(_T(get), 1, 64), 1, 64)[0].df, 5).withColumn("v", F.col("v") + 0.0))
query("tensor_irfft", f"SELECT i0, i1, round(v, 5) + 0.0 AS v FROM {_A}")(lambda get: rounded(X.irfft(*X.rfft(_T(get), 1, 64), 1, 64).df, 5).withColumn("v", F.col("v") + 0.0))
query("tensor_fft2", f"SELECT CAST(g AS INT) AS i0, CAST(f AS INT) AS i1, round(sum(v * cos(2 * pi() * (i1 * f / 64.0 + i0 * g / 16.0))), 4) + 0.0 AS v FROM {_A}, (SELECT unnest(range(64)) AS f), (SELECT unnest(range(16)) AS g) WHERE i0 < 16 GROUP BY ALL")(lambda get: rounded(X.fft2(_T(get).slice(0, 0, 16), 16, 64)[0].df, 4).withColumn("v", F.col("v") + 0.0))
query("tensor_ifft2", f"SELECT CAST(i0 AS INT) AS i0, i1, round(v, 5) + 0.0 AS v FROM {_A} WHERE i0 < 16")(lambda get: rounded(X.ifft2(*X.fft2(_T(get).slice(0, 0, 16), 16, 64), 16, 64)[0].df, 5).withColumn("v", F.col("v") + 0.0))
query("tensor_fftfreq", "SELECT range AS i0, CASE WHEN range < 5 THEN range ELSE range - 9 END / 4.5 AS v FROM range(9)")(lambda get: X.fftfreq(_S(get), 9, 0.5).df)
query("tensor_rfftfreq", "SELECT range AS i0, range / 5.0::DOUBLE AS v FROM range(6)")(lambda get: X.rfftfreq(_S(get), 10, 0.5).df)
query("tensor_fftshift", f"SELECT i0, (i1 + 32) % 64 AS i1, round(v, 6) AS v FROM {_A}")(lambda get: rounded(X.fftshift(_T(get), 1, 64).df, 6))
for name, make, sql in [("fabs", lambda c: U.fabs(-c), "abs(value)"), ("tree_add", lambda c: U.tree_add(c, c, F.lit(1.0)), "value * 2 + 1"), ("tree_multiply", lambda c: U.tree_multiply(c, c), "value * value"), ("around", lambda c: U.around(c * 8, 0), "round_even(value * 8, 0)"), ("isreal", lambda c: U.isreal(U.complex_(c, F.lit(0.0))).cast("int"), "1"), ("set_imag", lambda c: U.absolute(U.set_imag(U.complex_(c, F.lit(0.0)), F.lit(4.0))), "sqrt(value * value + 16)")]:
    query(f"numeric_{name}", f"SELECT event_id, round(CAST({sql} AS DOUBLE), 6) AS r FROM events")(lambda get, make=make: get("events").df.select("event_id", F.round(make(F.col("value")).cast("double"), 6).alias("r")))

# ---- kinds, sizes, lengths of time
query("bitwise_reversed", "SELECT o_orderkey, o_custkey & 12 AS a, o_custkey | 3 AS o, xor(o_custkey, 5) AS x FROM orders")(lambda get: (lambda f: f.df.select("o_orderkey", f["o_custkey"].rbitand(F.lit(12)).column.cast("bigint").alias("a"), f["o_custkey"].rbitor(F.lit(3)).column.cast("bigint").alias("o"), f["o_custkey"].rbitxor(F.lit(5)).column.cast("bigint").alias("x")))(get("orders")))
query("is_monotonic_decreasing", "SELECT false AS is_monotonic")(lambda get: get("events")["event_id"].is_monotonic_decreasing())
query("hasnans", "SELECT true AS hasnans")(lambda get: _nan(get)["x"].hasnans())
query("series_dot", "SELECT round(sum(o_totalprice * (o_custkey % 5)), 2) AS dot FROM orders")(lambda get: rounded((lambda f: f["o_totalprice"].dot(f["o_custkey"] % 5))(get("orders")).df, 2))
query("tshift", "SELECT event_id, ts + INTERVAL 3 HOUR AS r FROM events")(lambda get: (lambda f: f.df.select("event_id", f["ts"].tshift(3, "hour").column.alias("r")))(get("events")))
query("memory_usage", "SELECT 'o_orderkey' AS \"column\", 8 * count(*) AS bytes FROM orders UNION ALL SELECT 'o_orderstatus', CAST(sum(strlen(o_orderstatus)) AS BIGINT) FROM orders")(lambda get: get("orders").memory_usage(["o_orderkey", "o_orderstatus"]))
query("convert_dtypes", "SELECT p_partkey, p_size, p_retailprice, p_size % 2 = 0 AS even, p_name FROM part")(lambda get: get("part").df.selectExpr("p_partkey", "cast(p_size as string) p_size", "cast(p_retailprice as string) p_retailprice", "cast(p_size % 2 = 0 as string) even", "p_name").transform(lambda d: R.convert_dtypes(d)))
query("rechunk", "SELECT event_id FROM events")(lambda get: get("events").rechunk(5)[["event_id"]])
query("frame_to_tensor", "SELECT event_id AS i0, 0 AS i1, value AS v FROM events UNION ALL SELECT event_id, 1, CAST(user_id AS DOUBLE) FROM events")(lambda get: get("events").to_tensor(["value", "user_id"]).df)
query("frame_from_tensor", "SELECT event_id AS i0, value AS a, CAST(user_id AS DOUBLE) AS b FROM events")(lambda get: Frame.from_tensor(get("events").to_tensor(["value", "user_id"]), ["a", "b"]))
query("cut_even", "SELECT event_id, CAST(greatest(0, least(5, ceil((value - lo) / ((hi - lo) / 6)) - 1)) AS INT) AS bucket FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events)")(lambda get: get("events").cut("value", 6)[["event_id", "bucket"]])
query("merge_validate", "SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")(lambda get: get("nation").merge(get("region"), left_on="n_regionkey", right_on="r_regionkey", validate="m:1")[["n_nationkey", "r_name"]])
query("ewm_span", "WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) SELECT a.event_id, round(sum(b.value * pow(0.5, a.k - b.k)) / sum(pow(0.5, a.k - b.k)), 6) AS r FROM e a JOIN e b ON a.user_id = b.user_id AND b.k <= a.k GROUP BY ALL")(lambda get: rounded(get("events")[["event_id", "user_id", "value"]].ewm("value", by=["user_id"], name="r", span=3).df.select("event_id", "r"), 6))
query("groupby_rolling_time", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW), 4) AS r FROM events")(lambda get: rounded(get("events").groupby("user_id").rolling_time("value", "ts", 3600, "sum", "r").df.select("event_id", "r")))
query("groupby_rolling_time_both", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW), 4) AS r FROM events")(lambda get: rounded(get("events").groupby("user_id").rolling_time("value", "ts", 3600, "sum", "r", closed="both").df.select("event_id", "r")))
for name, kind, make, sql in [
    ("end_time", "t", lambda f: f["ts"].dt.end_time("h"), "date_trunc('hour', ts) + INTERVAL 1 HOUR - INTERVAL 1 MICROSECOND"), ("as_unit", "t", lambda f: f["ts"].dt.as_unit("s"), "date_trunc('second', ts)"), ("to_timestamp", "t", lambda f: f["ts"].dt.to_timestamp(), "ts"),
    ("freq", "s", lambda f: f["ts"].dt.freq("min"), "CASE WHEN date_trunc('minute', ts) = ts THEN 'min' END"), ("tz", "s", lambda f: f["ts"].dt.tz(), "'UTC'"), ("timetz", "s", lambda f: f["ts"].dt.timetz(), "strftime(ts, '%H:%M:%S.%f') || ' UTC'"),
    ("length_seconds", "i", lambda f: Series(f, F.col("ts").cast("timestamp_ntz") - F.lit("2000-01-01").cast("timestamp_ntz"), "d").dt.seconds(), "(epoch_us(ts) - epoch_us(TIMESTAMP '2000-01-01')) // 1000000 % 86400"), ("length_days", "i", lambda f: Series(f, F.col("ts").cast("timestamp_ntz") - F.lit("2000-01-01").cast("timestamp_ntz"), "d").dt.days(), "(epoch_us(ts) - epoch_us(TIMESTAMP '2000-01-01')) // 86400000000"),
]:
    column(f"dt_{name}", "events", kind, make, sql)
query("str_extractall", "SELECT p_partkey, array_to_string(regexp_extract_all(p_type, '([A-Z])([A-Z])', 1), ',') AS a, array_to_string(regexp_extract_all(p_type, '([A-Z])([A-Z])', 2), ',') AS b FROM part")(lambda get: (lambda f: f.df.select("p_partkey", f["p_type"].str.extractall("([A-Z])([A-Z])", 2).column.alias("m")).select("p_partkey", F.array_join(F.transform("m", lambda x: x[0]), ",").alias("a"), F.array_join(F.transform("m", lambda x: x[1]), ",").alias("b")))(get("part")))
query("str_isdecimal", "SELECT p_partkey, regexp_full_match(p_name, '[0-9]+') AS r FROM part")(lambda get: (lambda f: f.df.select("p_partkey", f["p_name"].str.isdecimal().column.alias("r")))(get("part")))
query("dict_list_at", "SELECT o_orderkey, o_custkey AS a, o_custkey AS b FROM orders")(lambda get: (lambda f: f.df.select("o_orderkey", f["m"].dict.at("k").column.alias("a"), f["l"].list.at(-1).column.alias("b")))(get("orders").assign(m=F.create_map(F.lit("k"), F.col("o_custkey")), l=F.array(F.lit(0), F.col("o_custkey")))))
query("model_apply_chunk", "SELECT p_partkey, 8 * p_size AS r FROM part")(lambda get: O.apply_chunk(get("part").df.select("p_partkey", "p_size"), O.EchoModel(), lambda m, b: pd.DataFrame({"p_partkey": b.p_partkey, "r": b.p_size * m.dim}), "p_partkey bigint, r int"))
