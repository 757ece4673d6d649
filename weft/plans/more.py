"""Queries of linear algebra, seeded randomness, model calls and index-free frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as U
from ..lite import LiteFrame, col
from ..operators import linalg as N
from ..operators import models as O
from ..operators import random as Z
from ..operators.tensor import Tensor
from .registry import query, rounded

_T = lambda get: Tensor.from_vectors(get("embeddings").df, "vec_id", "embedding")
_M = "(SELECT vec_id AS i0, CAST(unnest(range(64)) AS INT) AS i1, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
query("tensor_einsum", f"SELECT a.i1 AS i0, round(sum(a.v * b.v), 6) AS v FROM {_M} a JOIN (SELECT vec_id AS i0, CAST(label AS DOUBLE) AS v FROM embeddings) b USING (i0) GROUP BY a.i1")(lambda get: rounded(N.einsum("ij,i->j", _T(get), Tensor(get("embeddings").df.selectExpr("vec_id as i0", "cast(label as double) as v"), 1)).df, 6))
query("tensor_outer", "SELECT a.n_nationkey AS i0, b.n_nationkey AS i1, CAST(a.n_regionkey * b.n_regionkey AS DOUBLE) AS v FROM nation a, nation b")(lambda get: (lambda t: N.outer(t, t).df)(Tensor(get("nation").df.selectExpr("n_nationkey as i0", "cast(n_regionkey as double) as v"), 1)))
query("tensor_sort_rows", "SELECT vec_id, CAST(unnest(range(64)) AS INT) AS k, unnest(list_sort(CAST(embedding AS DOUBLE[]))) AS v FROM embeddings")(lambda get: get("embeddings").df.select("vec_id", F.posexplode(F.array_sort(F.transform("embedding", lambda x: x.cast("double")))).alias("k", "v")))
query("tensor_fft_power", "SELECT vec_id, CAST(f AS BIGINT) AS f, round(pow(sum(v * cos(2 * pi() * k * f / 64)), 2) + pow(sum(v * sin(2 * pi() * k * f / 64)), 2), 4) AS power FROM (SELECT vec_id, unnest(range(64)) AS k, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), (SELECT unnest(range(64)) AS f) GROUP BY ALL")(lambda get: rounded(get("embeddings").df.select("vec_id", N.row_fft(F.col("embedding")).alias("z")).select("vec_id", F.posexplode("z").alias("p", "x")).groupBy("vec_id", F.floor(F.col("p") / 2).alias("f")).agg(F.sum(F.col("x") * F.col("x")).alias("power"))))
query("linalg_svd")(lambda get: N.svd(get("embeddings").df.select("vec_id", "embedding"), "vec_id", "embedding", 64, 3)[0].select("vec_id", "u"))
query("linalg_qr")(lambda get: N.qr(get("embeddings").df.select("vec_id", "embedding"), "vec_id", "embedding", 64)[0].select("vec_id", "q"))
query("linalg_pca")(lambda get: N.pca(get("embeddings").df.select("vec_id", "embedding"), "vec_id", "embedding", 64, 3)[0].select("vec_id", "pc"))
for name, made in {"uniform": lambda k: Z.uniform(k, 1), "normal": lambda k: Z.normal(k, 1), "exponential": lambda k: Z.exponential(k, 1), "gumbel": lambda k: Z.gumbel(k, 1), "integers": lambda k: Z.integers(k, 0, 10, 1), "binomial": lambda k: Z.binomial(k, 5, 0.3, 1), "choice": lambda k: Z.choice(k, ["a", "b", "c"], 1)}.items():
    query(f"random_{name}")(lambda get, made=made: get("orders").df.select("o_orderkey", made(["o_orderkey"]).alias("r")))
query("model_generate", "SELECT p_partkey, 'About ' || p_name || ': ' || p_type AS response FROM part")(lambda get: O.generate(get("part").df, O.EchoModel(), "About {p_name}: {p_type}").select("p_partkey", "response"))
query("model_classify", "SELECT p_partkey, CASE WHEN contains(p_name, 'red') THEN 'red' WHEN contains(p_name, 'blue') THEN 'blue' END AS label FROM part")(lambda get: O.classify(get("part").df, O.EchoModel(), "p_name", ["red", "blue"]).select("p_partkey", "label"))
query("model_extract", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")(lambda get: O.extract(get("events").df, O.EchoModel(), "props", "k bigint").select("event_id", "extracted.k"))
query("model_embed", "SELECT p_partkey, CAST(length(p_name) AS DOUBLE) AS n FROM part")(lambda get: O.embed(get("part").df, O.EchoModel(), "p_name").select("p_partkey", F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x).alias("n")))
query("model_predict", "SELECT p_partkey, round(p_size * 2 + p_retailprice, 6) AS prediction FROM part")(lambda get: rounded(O.predict(get("part").df, lambda p: p.p_size * 2 + p.p_retailprice, ["p_size", "p_retailprice"]).select("p_partkey", "prediction"), 6))
query("remote_spawn", "SELECT range AS i, range * range AS result FROM range(5)")(lambda get: O.spawn(get("region").df.sparkSession, lambda x: x * x, [(k,) for k in range(5)], "bigint"))
query("lite_groupby", "SELECT o_orderstatus, round(sum(o_totalprice), 2) AS o_totalprice_sum, count(*) AS n FROM orders WHERE o_custkey > 100 GROUP BY ALL")(lambda get: rounded(LiteFrame(get("orders").df).filter(col("O_CUSTKEY") > 100).groupby("o_orderstatus").agg({"o_totalprice": "sum"}, n=("o_orderkey", "size")).df, 2))
query("lite_merge", "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")(lambda get: LiteFrame(get("nation").df).merge(LiteFrame(get("region").df), left_on="n_regionkey", right_on="r_regionkey").select("n_nationkey", "n_name", "r_name").df)
query("lite_select_expr", "SELECT o_orderkey, o_totalprice / 2 AS half FROM orders")(lambda get: LiteFrame(get("orders").df).select_expr("o_orderkey", "o_totalprice / 2 as half").df)

for name, make, sql in [
    ("exp2", lambda c: U.exp2(c / 50), "pow(2, value / 50)"), ("copysign", lambda c: U.copysign(c, F.lit(-1.0)), "-abs(value)"), ("fix", lambda c: U.fix(-c), "trunc(-value)"), ("fmod", lambda c: U.fmod(c, F.lit(7.0)), "fmod(value, 7.0)"),
    ("isclose", lambda c: U.isclose(c, F.lit(20.0), 0.01).cast("int"), "CAST(abs(value - 20) <= 1e-8 + 0.2 AS INT)"), ("ldexp", lambda c: U.ldexp(c, F.lit(3)), "value * 8"), ("modf", lambda c: U.modf(c)["fraction"], "value - trunc(value)"), ("logaddexp2", lambda c: U.logaddexp2(c / 50, F.lit(1.0)), "log2(pow(2, value / 50) + 2)"),
    ("expit", lambda c: U.expit(c / 50), "1 / (1 + exp(-value / 50))"), ("logit", lambda c: U.logit((c + 1) / 1e6), "ln((value + 1) / 1e6 / (1 - (value + 1) / 1e6))"), ("softplus", lambda c: U.softplus(c / 50), "ln(1 + exp(value / 50))"), ("xlogy", lambda c: U.xlogy(c, F.lit(3.0)), "value * ln(3)"), ("entr", lambda c: U.entr(c + 1), "-(value + 1) * ln(value + 1)"), ("rel_entr", lambda c: U.rel_entr(c + 1, F.lit(2.0)), "(value + 1) * ln((value + 1) / 2)"), ("kl_div", lambda c: U.kl_div(c + 1, F.lit(2.0)), "(value + 1) * ln((value + 1) / 2) - (value + 1) + 2"), ("poch", lambda c: U.poch(c / 50, 3), "(value / 50) * (value / 50 + 1) * (value / 50 + 2)"),
    ("gammaln", lambda c: U.special("gammaln")(c / 10 + 1), "lgamma(value / 10 + 1)"), ("gamma", lambda c: U.special("gamma")(c / 1000 + 1), "gamma(value / 1000 + 1)"), ("complex_abs", lambda c: U.absolute(U.complex_(c, F.lit(3.0))), "sqrt(value * value + 9)"), ("complex_angle", lambda c: U.angle(U.conj(U.complex_(c, F.lit(3.0)))), "atan2(-3.0, value)"),
]:
    query(f"numeric_{name}", f"SELECT event_id, round(CAST({sql} AS DOUBLE), 6) + 0.0 AS r FROM events")(lambda get, make=make: get("events").df.select("event_id", (F.round(make(F.col("value")).cast("double"), 6) + F.lit(0.0)).alias("r")))
query("numeric_softmax", "SELECT vec_id, CAST(unnest(range(64)) AS INT) AS k, round(exp(CAST(unnest(embedding) AS DOUBLE)) / (SELECT sum(exp(x::DOUBLE)) FROM (SELECT unnest(embedding) AS x)), 8) AS r FROM embeddings")(lambda get: rounded(get("embeddings").df.select("vec_id", F.posexplode(U.softmax(F.col("embedding"))).alias("k", "r")), 8))
for name, make, sql in [
    ("sort", lambda t: t.sort(1), f"SELECT i0, row_number() OVER (PARTITION BY i0 ORDER BY v) - 1 AS i1, round(v, 6) AS v FROM {_M}"),
    ("argsort", lambda t: t.argsort(1), f"SELECT i0, row_number() OVER (PARTITION BY i0 ORDER BY v, i1) - 1 AS i1, CAST(i1 AS DOUBLE) AS v FROM {_M}"),
    ("topk", lambda t: t.topk(3, 1), f"SELECT i0, row_number() OVER (PARTITION BY i0 ORDER BY v DESC, i1) - 1 AS i1, round(v, 6) AS v FROM {_M} QUALIFY row_number() OVER (PARTITION BY i0 ORDER BY v DESC, i1) <= 3"),
    ("percentile", lambda t: t.percentile(30, 0), f"SELECT i1 AS i0, round(quantile_cont(v, 0.3), 6) AS v FROM {_M} GROUP BY i1"),
    ("repeat", lambda t: t.repeat(2, 1), f"SELECT i0, i1 * 2 + k AS i1, round(v, 6) AS v FROM {_M}, (SELECT unnest([0, 1]) AS k)"),
    ("tile", lambda t: t.tile(2, 1, 64), f"SELECT i0, i1 + k * 64 AS i1, round(v, 6) AS v FROM {_M}, (SELECT unnest([0, 1]) AS k)"),
    ("delete", lambda t: t.delete([0, 5], 1), f"SELECT i0, i1 - CAST(i1 > 0 AS INT) - CAST(i1 > 5 AS INT) AS i1, round(v, 6) AS v FROM {_M} WHERE i1 NOT IN (0, 5)"),
    ("take", lambda t: t.take([7, 3], 1), f"SELECT i0, CASE i1 WHEN 7 THEN 0 ELSE 1 END AS i1, round(v, 6) AS v FROM {_M} WHERE i1 IN (3, 7)"),
    ("stack", lambda t: Tensor.stack([t, t * 2.0]), f"SELECT 0 AS i0, i0 AS i1, i1 AS i2, round(v, 6) AS v FROM {_M} UNION ALL SELECT 1, i0, i1, round(v * 2, 6) FROM {_M}"),
    ("moveaxis", lambda t: t.moveaxis(0, 1), f"SELECT i1 AS i0, i0 AS i1, round(v, 6) AS v FROM {_M}"),
    ("cov", lambda t: Tensor(t.cov().df.withColumn("v", F.round("v", 6) + F.lit(0.0)), 2), f"SELECT a.i1 AS i0, b.i1, round(covar_samp(a.v, b.v), 6) + 0.0 AS v FROM {_M} a JOIN {_M} b USING (i0) GROUP BY a.i1, b.i1"),
    ("corrcoef", lambda t: t.corrcoef(), f"SELECT a.i1 AS i0, b.i1, round(corr(a.v, b.v), 6) AS v FROM {_M} a JOIN {_M} b USING (i0) GROUP BY a.i1, b.i1"),
    ("trapezoid", lambda t: t.trapezoid(1), f"SELECT i0, round(sum((v + l) / 2), 6) AS v FROM (SELECT i0, v, lag(v) OVER (PARTITION BY i0 ORDER BY i1) AS l FROM {_M}) GROUP BY i0"),
    ("average", lambda t: t.average(Tensor(t.df.select("i1").distinct().select(F.col("i1").alias("i0"), (F.col("i1") + 1.0).alias("v")), 1), 1), f"SELECT i0, round(sum(v * (i1 + 1)) / sum(i1 + 1), 6) AS v FROM {_M} GROUP BY i0"),
    ("fill_diagonal", lambda t: t.fill_diagonal(9), f"SELECT i0, i1, CASE WHEN i0 = i1 THEN 9 ELSE round(v, 6) END AS v FROM {_M}"),
    ("vdot", lambda t: t.vdot(t), f"SELECT round(sum(v * v), 6) AS v FROM {_M}"),
]:
    query(f"tensor_{name}", sql)(lambda get, make=make: rounded(make(_T(get)).df, 6))
query("tensor_allclose", "SELECT true AS allclose")(lambda get: (lambda t: t.allclose(t + 1e-9))(_T(get)))
query("tensor_array_equal", "SELECT false AS array_equal")(lambda get: (lambda t: t.array_equal(t + 1e-6))(_T(get)))
for how, sql in {"sum": "sum(value)", "max": "max(value)", "min": "min(value)", "count": "count(value)"}.items():
    query(f"frame_cum{how}", f"SELECT event_id, round(CAST({sql} OVER (ORDER BY event_id) AS DOUBLE), 4) AS r FROM events")(lambda get, how=how: get("events").cumulative("value", how, "r").df.select("event_id", F.round(F.col("r").cast("double"), 4).alias("r")))
