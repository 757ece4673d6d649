"""Queries of learning and array operators, and of sources and sinks."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..operators import learn as M
from ..operators import tensor as X
from ..operators.tensor import Tensor
from ..session import shared_path
from ..sources import readers, writers
from .registry import query, rounded

_pred = lambda get: get("orders").df.selectExpr("cast(o_totalprice > 250000 as int) as y", "cast(o_custkey % 1000 > 400 as int) as p", "(o_custkey % 97) / 97.0D as s")
_sql = "(SELECT CAST(o_totalprice > 250000 AS INT) AS y, CAST(o_custkey % 1000 > 400 AS INT) AS p, (o_custkey % 97) / 97.0 AS s FROM orders)"
query("learn_accuracy", f"SELECT round(avg(CAST(y = p AS INT)), 8) AS accuracy FROM {_sql}")(lambda get: rounded(M.accuracy_score(_pred(get), "y", "p"), 8))
query("learn_confusion", f'SELECT y AS "true", p AS pred, count(*) AS n FROM {_sql} GROUP BY ALL')(lambda get: M.confusion(_pred(get), "y", "p"))
query("learn_precision_recall", f"SELECT l AS label, round(coalesce(count(*) FILTER (y = l AND p = l) / nullif(count(*) FILTER (p = l), 0), 0), 8) AS precision, round(coalesce(count(*) FILTER (y = l AND p = l) / nullif(count(*) FILTER (y = l), 0), 0), 8) AS recall, round(2 * count(*) FILTER (y = l AND p = l) / (count(*) FILTER (p = l) + count(*) FILTER (y = l)), 8) AS fscore, count(*) FILTER (y = l) AS support FROM {_sql}, (SELECT unnest([0, 1]) AS l) GROUP BY ALL")(lambda get: rounded(M.precision_recall_fscore(_pred(get), "y", "p"), 8))
query("learn_log_loss", f"SELECT round(avg(-CASE WHEN y = 1 THEN ln(greatest(s, 1e-15)) ELSE ln(1 - s) END), 6) AS log_loss FROM {_sql}")(lambda get: rounded(M.log_loss(_pred(get), "y", "s"), 6))
_roc = f"WITH b AS (SELECT s, sum(y) AS p, sum(1 - y) AS n FROM {_sql} GROUP BY ALL), c AS (SELECT s AS threshold, sum(n) OVER w / (SELECT sum(n) FROM b) AS fpr, sum(p) OVER w / (SELECT sum(p) FROM b) AS tpr FROM b WINDOW w AS (ORDER BY s DESC)) "
query("learn_roc_curve", _roc + "SELECT round(threshold, 8) AS threshold, round(fpr, 8) AS fpr, round(tpr, 8) AS tpr FROM c")(lambda get: rounded(M.roc_curve(_pred(get), "y", "s"), 8))
query("learn_roc_auc", _roc + "SELECT round(sum((fpr - f) * (tpr + t) / 2), 8) AS auc FROM (SELECT fpr, tpr, coalesce(lag(fpr) OVER (ORDER BY fpr, tpr), 0) AS f, coalesce(lag(tpr) OVER (ORDER BY fpr, tpr), 0) AS t FROM c)")(lambda get: rounded(M.roc_auc_score(_pred(get), "y", "s"), 8))
query("learn_r2", "SELECT round(1 - sum(pow(o_totalprice - o_custkey * 300, 2)) / (var_pop(o_totalprice) * count(*)), 6) AS r2 FROM orders")(lambda get: rounded(M.r2_score(get("orders").df.withColumn("p", F.col("o_custkey") * 300), "o_totalprice", "p"), 6))
_E = "CAST({} AS DOUBLE[])"
for metric, sql in {"euclidean": "list_distance({a}, {b})", "cosine": "1 - list_dot_product({a}, {b}) / sqrt(list_dot_product({a}, {a}) * list_dot_product({b}, {b}))", "cosine_similarity": "list_dot_product({a}, {b}) / sqrt(list_dot_product({a}, {a}) * list_dot_product({b}, {b}))", "rbf": "exp(-pow(list_distance({a}, {b}), 2) / 64)"}.items():
    made = sql.format(a=_E.format("q.embedding"), b=_E.format("e.embedding"))
    # similarity is of all pairs; distances are searches, whose queries are every fiftieth row
    of = "true" if metric == "cosine_similarity" else "vec_id % 50 = 0"
    where = "" if of == "true" else f" WHERE q.{of}"
    query(f"learn_pairwise_{metric}", f"SELECT q.vec_id AS query, e.vec_id AS key, round({made}, 6) AS distance FROM embeddings q, embeddings e{where}")(lambda get, metric=metric, of=of: rounded(M.pairwise_distances(get("embeddings").df.where(of), get("embeddings").df, "vec_id", "embedding", metric), 6))
query("learn_pairwise_manhattan", "SELECT q.vec_id AS query, e.vec_id AS key, round((SELECT sum(abs(x - y)) FROM (SELECT unnest(CAST(q.embedding AS DOUBLE[])) AS x, unnest(CAST(e.embedding AS DOUBLE[])) AS y)), 6) AS distance FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0")(lambda get: rounded(M.pairwise_distances(get("embeddings").df.where("vec_id % 50 = 0"), get("embeddings").df, "vec_id", "embedding", "manhattan"), 6))
query("learn_pairwise_topk", "SELECT query, key, rank FROM (SELECT q.vec_id AS query, e.vec_id AS key, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), e.vec_id) AS INT) AS rank FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id) WHERE rank <= 5")(lambda get: M.pairwise_topk(get("embeddings").df.where("vec_id % 50 = 0"), get("embeddings").df, "vec_id", "embedding", 5).select("query", "key", "rank"))
query("learn_haversine", "SELECT o_orderkey, round(2 * asin(sqrt(pow(sin((o_custkey / 1000.0 - 0.5) / 2), 2) + cos(0.5) * cos(o_custkey / 1000.0) * pow(sin((o_orderkey / 10000.0 - 0.1) / 2), 2))), 8) AS d FROM orders")(lambda get: get("orders").df.select("o_orderkey", F.round(M.haversine(F.lit(0.5), F.lit(0.1), F.col("o_custkey") / 1000, F.col("o_orderkey") / 10000), 8).alias("d")))
query("learn_normalize", "SELECT vec_id, CAST(unnest(range(64)) AS INT) AS k, round(CAST(unnest(embedding) AS DOUBLE) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS x FROM embeddings")(lambda get: rounded(M.normalize(get("embeddings").df, "embedding").select("vec_id", F.posexplode("embedding").alias("k", "x")), 6))
query("learn_standard_scale", "SELECT o_orderkey, round((o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_pop(o_totalprice) FROM orders), 7) AS o_totalprice FROM orders")(lambda get: rounded(M.standard_scale(get("orders").df.select("o_orderkey", "o_totalprice"), ["o_totalprice"]), 7))
query("learn_minmax_scale", "SELECT o_orderkey, round((o_totalprice - (SELECT min(o_totalprice) FROM orders)) / (SELECT max(o_totalprice) - min(o_totalprice) FROM orders), 8) AS o_totalprice FROM orders")(lambda get: rounded(M.minmax_scale(get("orders").df.select("o_orderkey", "o_totalprice"), ["o_totalprice"]), 8))
query("learn_label_encode", "SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INT) AS code FROM orders")(lambda get: M.label_encode(get("orders").df, "o_orderpriority").select("o_orderkey", "code"))
query("learn_label_binarize", "SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INT) AS f, CAST(o_orderstatus = 'O' AS INT) AS o, CAST(o_orderstatus = 'P' AS INT) AS p FROM orders")(lambda get: M.label_binarize(get("orders").df, "o_orderstatus", ["F", "O", "P"]).select("o_orderkey", *[F.get("onehot", k).alias(c) for k, c in enumerate("fop")]))
query("learn_train_test_split")(lambda get: M.train_test_split(get("orders").df, ["o_orderkey"])[1].select("o_orderkey"))
query("learn_shuffle", "SELECT o_orderkey FROM orders")(lambda get: M.shuffle(get("orders").df, ["o_orderkey"]).select("o_orderkey"))
query("learn_k_means")(lambda get: M.k_means(get("embeddings").df, "embedding", 10)[0].select("vec_id", "cluster"))
query("learn_linear_regression", "SELECT o_orderkey, round(regr_intercept(o_totalprice, o_custkey) OVER () + regr_slope(o_totalprice, o_custkey) OVER () * o_custkey, 2) AS prediction FROM orders")(lambda get: (lambda d: rounded(M.linear_predict(d, ["o_custkey"], M.linear_fit(d, ["o_custkey"], "o_totalprice")).select("o_orderkey", "prediction"), 2))(get("orders").df))
query("learn_logistic_regression")(lambda get: (lambda d: M.linear_predict(d, ["s"], M.logistic_fit(d, ["s"], "y")).select("s", "prediction").distinct())(_pred(get)))



def _whole_components(get):
    """All customers, ids as they are."""
    found, done = M.connected_components(get("customer").df.selectExpr("c_custkey as a", "c_custkey * 7 as b"), max_iter=100)
    if not done:
        raise RuntimeError("components not settled")
    return found


# the root of a number is what is left when sevens are taken out while that gives a customer
_ROOTS = "WITH RECURSIVE n AS (SELECT c_custkey AS id FROM customer UNION SELECT c_custkey * 7 FROM customer), r(id, c) AS (SELECT id, id FROM n UNION ALL SELECT r.id, r.c // 7 FROM r JOIN customer ON c_custkey = r.c // 7 WHERE r.c % 7 = 0 AND r.c > 0) SELECT id, min(c) AS component FROM r GROUP BY id HAVING min(c) <> id"
query("learn_connected_components", _ROOTS)(_whole_components)
query("learn_connected_components_whole", _ROOTS)(_whole_components)

# ---- arrays: rows of embeddings as a matrix
_T = lambda get: Tensor.from_vectors(get("embeddings").df, "vec_id", "embedding")
_M = "(SELECT vec_id AS i0, CAST(unnest(range(64)) AS INT) AS i1, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
for how, sql in {"sum": "sum(v)", "mean": "avg(v)", "min": "min(v)", "max": "max(v)", "var": "var_pop(v)", "std": "stddev_pop(v)", "median": "median(v)", "ptp": "max(v) - min(v)", "count_nonzero": "sum(CAST(v <> 0 AS INT))"}.items():
    query(f"tensor_{how}_axis0", f"SELECT i1 AS i0, round(CAST({sql} AS DOUBLE), 6) AS v FROM {_M} GROUP BY i1")(lambda get, how=how: rounded(_T(get).reduce(how, 0).df, 6))
    query(f"tensor_{how}_axis1", f"SELECT i0, round(CAST({sql} AS DOUBLE), 6) AS v FROM {_M} GROUP BY i0")(lambda get, how=how: rounded(_T(get).reduce(how, 1).df, 6))
for name, make, sql in [
    ("argmax", lambda t: t.arg("max", 1), f"SELECT i0, CAST(arg_max(i1, (v, -i1)) AS DOUBLE) AS v FROM {_M} GROUP BY i0"),
    ("argmin", lambda t: t.arg("min", 1), f"SELECT i0, CAST(arg_min(i1, (v, i1)) AS DOUBLE) AS v FROM {_M} GROUP BY i0"),
    ("cumsum", lambda t: t.cum("sum", 1), f"SELECT i0, i1, round(sum(v) OVER (PARTITION BY i0 ORDER BY i1), 6) AS v FROM {_M}"),
    ("diff", lambda t: t.diff(1), f"SELECT i0, CAST(i1 - 1 AS INT) AS i1, round(d, 6) AS v FROM (SELECT i0, i1, v - lag(v) OVER (PARTITION BY i0 ORDER BY i1) AS d FROM {_M}) WHERE d IS NOT NULL"),
    ("transpose", lambda t: t.transpose(), f"SELECT i1 AS i0, i0 AS i1, round(v, 6) AS v FROM {_M}"),
    ("flip", lambda t: t.flip(1, 64), f"SELECT i0, 63 - i1 AS i1, round(v, 6) AS v FROM {_M}"),
    ("roll", lambda t: t.roll(1, 5, 64), f"SELECT i0, (i1 + 5) % 64 AS i1, round(v, 6) AS v FROM {_M}"),
    ("slice", lambda t: t.slice(1, 10, 30, 2), f"SELECT i0, (i1 - 10) // 2 AS i1, round(v, 6) AS v FROM {_M} WHERE i1 >= 10 AND i1 < 30 AND i1 % 2 = 0"),
    ("where", lambda t: t.where(lambda v: v > 0), f"SELECT i0, i1, round(CASE WHEN v > 0 THEN v ELSE 0 END, 6) AS v FROM {_M}"),
    ("gram", lambda t: t.transpose().matmul(t), f"SELECT a.i1 AS i0, b.i1, round(sum(a.v * b.v), 6) AS v FROM {_M} a JOIN {_M} b ON a.i0 = b.i0 GROUP BY a.i1, b.i1"),
    ("add", lambda t: t + t * 2.0, f"SELECT i0, i1, round(v * 3, 6) AS v FROM {_M}"),
    ("norm", lambda t: t.norm(), f"SELECT round(sqrt(sum(v * v)), 6) AS v FROM {_M}"),
    ("tril", lambda t: t.tril(), f"SELECT i0, i1, round(v, 6) AS v FROM {_M} WHERE i0 >= i1"),
    ("trace", lambda t: t.trace(), f"SELECT round(sum(v), 6) AS v FROM {_M} WHERE i0 = i1"),
    ("concat", lambda t: t.concat(t, 1, 64), f"SELECT i0, i1, round(v, 6) AS v FROM {_M} UNION ALL SELECT i0, i1 + 64, round(v, 6) FROM {_M}"),
]:
    query(f"tensor_{name}", sql)(lambda get, make=make: rounded(make(_T(get)).df, 6))
query("tensor_reshape", f"SELECT i0 * 2 + i1 // 32 AS i0, i1 % 32 AS i1, round(v, 6) AS v FROM {_M}")(lambda get: (lambda n: rounded(_T(get).reshape((n, 64), (2 * n, 32)).df, 6))(get("embeddings").df.count()))
query("tensor_histogram", "SELECT CAST(least(floor(value / 10), 9) AS BIGINT) AS bin, count(*) AS n FROM events WHERE value BETWEEN 0 AND 100 GROUP BY ALL")(lambda get: X.histogram(get("events").df, "value", 10, 0, 100))
query("tensor_bincount", "SELECT CAST(p_size AS BIGINT) AS k, count(*) AS n FROM part GROUP BY ALL")(lambda get: X.bincount(get("part").df, "p_size"))
query("tensor_searchsorted", "SELECT event_id, CAST(value > 5 AS INT) + CAST(value > 20 AS INT) + CAST(value > 50 AS INT) AS r FROM events")(lambda get: get("events").df.select("event_id", X.searchsorted(F.col("value"), [5, 20, 50]).alias("r")))
query("tensor_arange_linspace", "SELECT range AS i0, round(range / 99.0, 8) AS v FROM range(100)")(lambda get: rounded(Tensor.linspace(get("region").df.sparkSession, 0.0, 1.0, 100).df, 8))


# ---- sources and sinks: written, read again
def _round_trip(write, read):
    def run(get):
        df = get("orders").df.select("o_orderkey", "o_orderstatus", "o_totalprice")
        path = shared_path(df.sparkSession)
        write(df, path)
        return read(df.sparkSession, path)

    return run


_same = "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders"
_S = "o_orderkey bigint, o_orderstatus string, o_totalprice double"
query("io_csv", _same)(_round_trip(lambda d, p: writers.to_csv(d, p), lambda s, p: readers.read_csv(s, p, schema=_S)))
query("io_json", _same)(_round_trip(lambda d, p: writers.to_json(d, p), lambda s, p: readers.read_json(s, p, schema=_S)))
query("io_parquet", _same + " WHERE o_orderstatus = 'F'")(_round_trip(lambda d, p: writers.to_parquet(d, p, partition_cols=["o_orderstatus"]), lambda s, p: readers.read_parquet(s, p, filters=[("o_orderstatus", "=", "F")]).select("o_orderkey", "o_orderstatus", "o_totalprice")))
query("io_orc", _same)(_round_trip(lambda d, p: writers.to_orc(d, p), lambda s, p: readers.read_orc(s, p)))
query("io_sql", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")(lambda get: readers.read_sql(get("orders").df.sparkSession, "SELECT o_orderstatus, count(*) AS n FROM {orders} GROUP BY o_orderstatus", orders=get("orders").df))
query("io_date_range", "SELECT d AS date FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-03-01', INTERVAL 1 DAY)) AS d)")(lambda get: readers.date_range(get("region").df.sparkSession, "2024-01-01", "2024-03-01", "1 day"))
query("io_from_dict", "SELECT * FROM (VALUES (1, 'a'), (2, 'b')) t(x, y)")(lambda get: readers.from_dict(get("region").df.sparkSession, {"x": [1, 2], "y": ["a", "b"]}))
