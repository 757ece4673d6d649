"""Semantics that a plain translation gets wrong, and what SQL does not show."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weft.frame import Frame
from weft.functions import media
from weft.operators import dataflow, learn, linalg, random, ranges
from weft.sources import readers, writers
from weft.streaming import sinks


def made(spark, rows, schema, order=()):
    return Frame(spark.createDataFrame(rows, schema), list(order), list(order))


def test_mod_takes_divisors_sign(spark):
    f = made(spark, [(7, -3), (-7, 3), (7, 0)], "a int, b int")
    got = f.df.select((f["a"] % f["b"]).column.alias("m"), (f["a"] // f["b"]).column.alias("d")).collect()
    assert [tuple(r) for r in got] == [(-2.0, -3.0), (2.0, -3.0), (None, None)]


def test_missing_compares_false_but_ne_true(spark):
    f = made(spark, [(None,), (1,)], "a int")
    assert [tuple(r) for r in f.df.select((f["a"] == 1).column, (f["a"] != 1).column).collect()] == [(False, True), (True, False)]


def test_missing_keys_match_in_merge_and_leave_groups(spark):
    a, b = made(spark, [(None, 1), (2, 2)], "k int, x int"), made(spark, [(None, 5)], "k int, y int")
    assert [tuple(r) for r in a.merge(b, on="k").df.collect()] == [(None, 1, 5)]
    assert a.groupby("k").size().df.count() == 1
    assert a.groupby("k", dropna=False).size().df.count() == 2


def test_sort_puts_missing_last(spark):
    f = made(spark, [(None,), (1,), (2,)], "a int")
    for up in (True, False):
        assert f.sort_values("a", ascending=up).df.collect()[-1][0] is None


def test_skew_and_kurt_are_adjusted(spark):
    v = [1.0, 2.0, 9.0, 4.0, 7.5]
    got = made(spark, [(x,) for x in v], "a double")["a"].agg("skew", "kurt", "sem").df.first()
    s = pd.Series(v)
    assert got[0] == pytest.approx(s.skew()) and got[1] == pytest.approx(s.kurt()) and got[2] == pytest.approx(s.sem())


def test_sum_of_nothing_is_zero(spark):
    assert made(spark, [(None,)], "a double")["a"].sum().df.first()[0] == 0
    assert made(spark, [(None,)], "a double")["a"].sum(min_count=1).df.first()[0] is None


def test_ewm_as_pandas(spark):
    rows = [(1, k, v) for k, v in enumerate([1.0, None, 3.0, 4.0])]
    got = made(spark, rows, "g int, t int, v double", ["t"]).ewm("v", 0.3, ["g"], "e").df.orderBy("t").toPandas()
    want = pd.Series([1.0, None, 3.0, 4.0]).ewm(alpha=0.3).mean()
    assert got.e.tolist() == pytest.approx(want.tolist())


def test_str_functions_as_pandas(spark):
    words = ["the Quick  brown", "-12", "", "abcabc", "x1y"]
    f = made(spark, [(w,) for w in words], "a string")
    s = pd.Series(words)
    for name, args in [("capitalize", ()), ("swapcase", ()), ("zfill", (5,)), ("center", (8, "*")), ("rfind", ("b",)), ("ljust", (6,)), ("removesuffix", ("bc",))]:
        got = [r[0] for r in f.df.select(getattr(f["a"].str, name)(*args).column).collect()]
        assert got == getattr(s.str, name)(*args).tolist(), name


def test_flow_checks(spark):
    f = made(spark, [(1,)], "a int")
    with pytest.raises(ValueError):
        f.mf.reshuffle(sort_by=["a"])
    with pytest.raises(ValueError):
        f.mf.rebalance()


def test_components_report_the_end(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)], "a int, b int")
    found, done = learn.connected_components(edges, max_iter=20)
    assert done and found.count() == 40 and found.select("component").distinct().collect()[0][0] == 0
    assert not learn.connected_components(edges, max_iter=1)[1]


def test_linear_and_logistic(spark):
    df = learn.make_regression(spark, 500, [2.0, -1.0], seed=3)
    assert learn.linear_fit(df, ["x0", "x1"], "y") == pytest.approx([2, -1, 0], abs=1e-6)
    df = df.withColumn("z", (F.col("x0") + F.randn(5) > 0).cast("int"))
    assert learn.logistic_fit(df, ["x0"], "z")[0] > 1


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.to_parquet(spark.range(100).withColumn("p", F.col("id") % 4), path, ["p"])
    df = readers.read_parquet(spark, path, ["id"], [("p", "=", 1), ("id", ">", 50)])
    plan = df._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(p" in plan and "PushedFilters: [IsNotNull(id)" in plan and df.count() == 12


def test_stream_of_files(spark, tmp_path):
    spark.range(10).selectExpr("id", "timestamp_seconds(id * 60) ts").write.parquet(str(tmp_path / "in"))
    stream = sinks.read_stream(spark, str(tmp_path / "in"), "id bigint, ts timestamp")
    seen = []
    sinks.for_each(stream, lambda df, k: seen.append(df.count()), str(tmp_path / "c")).awaitTermination()
    assert sum(seen) == 10
    agg = sinks.windowed_agg(sinks.read_stream(spark, str(tmp_path / "in"), "id bigint, ts timestamp"), "ts", "5 minutes", [], F.count("*").alias("n"))
    assert agg.isStreaming


def test_linear_algebra(spark):
    x = np.random.default_rng(0).normal(size=(50, 4))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "i bigint, v array<double>")
    rows, s, v = linalg.svd(df, "i", "v", 4, 4)
    u = np.array([r.u for r in rows.orderBy("i").collect()])
    assert np.allclose(u * s @ v.T, x)
    rows, r = linalg.qr(df, "i", "v", 4)
    q = np.array([r.q for r in rows.orderBy("i").collect()])
    assert np.allclose(q @ r, x) and np.allclose(q.T @ q, np.eye(4))
    assert np.isclose(linalg.pca(df, "i", "v", 4, 4)[1].sum(), 1)
    a = x[:4]
    p, low, up = linalg.lu(a)
    assert np.allclose(p @ low @ up, a) and np.allclose(np.triu(up), up)
    assert np.allclose(linalg.lstsq(df.withColumn("y", F.expr("v[0] * 2 - v[3]")), "i", "v", "y", 4), [2, 0, 0, -1])


def test_random_does_not_depend_on_partitions(spark):
    df = spark.range(20000)
    one = df.select("id", random.normal(["id"], 3).alias("r")).orderBy("id").toPandas()
    two = df.repartition(7).select("id", random.normal(["id"], 3).alias("r")).orderBy("id").toPandas()
    assert one.equals(two) and abs(one.r.mean()) < 0.03 and abs(one.r.std() - 1) < 0.03


def test_media_headers(spark):
    import io
    import struct
    import wave

    sound = io.BytesIO()
    with wave.open(sound, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(struct.pack("<4h", 1, -2, 3, 4))
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 7, 5) + b"rest"
    df = spark.createDataFrame([(1, bytearray(sound.getvalue())), (2, bytearray(png)), (3, None), (4, bytearray(b"junk"))], "k int, b binary")
    got = df.select("k", media.audio_property("b").alias("a"), media.image_property("b").alias("i"), media.audio_decode("b").alias("s")).orderBy("k").collect()
    assert (got[0].a.rate, got[0].a.frames, got[0].s) == (8000, 4, [1, -2, 3, 4])
    assert (got[1].i.width, got[1].i.height, got[1].i.format) == (7, 5, "PNG")
    assert got[2].s is None and got[3].i.width is None


def test_whole_components_and_missing_keys(spark):
    """The registered queries on all rows of the smallest tables, against brute force."""
    from collections import Counter, defaultdict

    from weft.plans import registry

    folder, queries = "/root/testdata/sf0.001", registry.queries()
    root = {}

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for (k,) in spark.read.parquet(f"{folder}/customer.parquet").select("c_custkey").collect():
        p, q = find(k), find(k * 7)
        root[max(p, q)] = min(p, q)
    got = queries["learn_connected_components_whole"](spark, folder).collect()
    assert sorted(map(tuple, got)) == sorted((v, find(v)) for v in root if find(v) != v)
    parts = defaultdict(list)
    for k, size in spark.read.parquet(f"{folder}/part.parquet").select("p_partkey", "p_size").collect():
        parts[size % 50 or None].append(k)
    want = Counter((x, y) for keys in parts.values() for x in keys for y in keys)
    assert Counter(map(tuple, queries["merge_missing_keys_whole"](spark, folder).select("x", "y").collect())) == want


def test_merge_of_many_rows_of_a_key_is_dealt(spark):
    from weft.operators import join
    from weft.plans import registry

    pairs = registry.queries()["merge_missing_keys"](spark, "/root/testdata/sf0.01").groupBy(F.spark_partition_id().alias("p")).count().toPandas()["count"]
    assert len(pairs) >= 8 and pairs.max() < pairs.sum() / 4
    a = spark.createDataFrame([(None, -0.0, 1), (None, 0.0, None), (3, 0.0, 7), (3, 0.0, 7), (4, float("nan"), 8), (5, 1.0, 9)] + [(6, 2.0, k % 3) for k in range(1500)], "k int, f double, x int")
    b = spark.createDataFrame([(0.0, None, "a"), (-0.0, None, None), (0.0, 3, "b"), (0.0, 3, "b"), (float("nan"), 4, "c"), (2.0, 6, "d")], "f double, k bigint, x string")
    for how in ({"on": ["k", "f"], "indicator": True}, {"on": "k"}, {"left_on": ["k", "f"], "right_on": ["k", "f"]}):
        want, got = join.merge(a, b, **how), join.merge(a, b, many=True, **how)
        assert got.dtypes == want.dtypes
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    keys = a.select("k")
    assert join.merge(keys, keys, on="k", many=True).count() == join.merge(keys, keys, on="k").count() == 1500**2 + 10
    with pytest.raises(ValueError):
        join.merge(a, b, on="k", how="left", many=True)


@pytest.mark.parametrize("name", ["merge_missing_keys", "merge_missing_keys_whole"])
def test_pairs_of_blocks_are_not_written(spark, name):
    from weft.plans import registry

    made = registry.queries()[name](spark, "/root/testdata/sf0.01")
    above, _, below = made._jdf.queryExecution().executedPlan().toString().partition("CartesianProduct")
    assert "Exchange" not in above and "collect_list" in below


# ---- seeded columns: mean and variance of each distribution
def _moments(spark, make):
    got = spark.range(20_000).select(make(["id"]).cast("double").alias("r")).toPandas().r.to_numpy()
    assert np.isfinite(got).all()
    return got.mean(), got.var()


@pytest.mark.parametrize(
    "name, make, mean, var",
    [
        ("gamma", lambda k: random.gamma(k, 2.5, 2.0), 5, 10),
        ("gamma below one", lambda k: random.standard_gamma(k, 0.5), 0.5, 0.5),
        ("chisquare", lambda k: random.chisquare(k, 3), 3, 6),
        ("beta", lambda k: random.beta(k, 2, 3), 0.4, 0.04),
        ("f", lambda k: random.f(k, 4, 20), 20 / 18, 2 * 400 * 22 / (4 * 18 * 18 * 16)),
        ("standard_t", lambda k: random.standard_t(k, 12), 0, 1.2),
        ("noncentral_chisquare", lambda k: random.noncentral_chisquare(k, 3, 2), 5, 14),
        ("wald", lambda k: random.wald(k, 2, 5), 2, 8 / 5),
        ("vonmises", lambda k: random.vonmises(k, 0.5, 8.0), 0.5, 0.134),
        ("poisson", lambda k: random.poisson(k, 6.5), 6.5, 6.5),
        ("negative_binomial", lambda k: random.negative_binomial(k, 4, 0.4), 6, 15),
        ("hypergeometric", lambda k: random.hypergeometric(k, 7, 13, 6), 2.1, 6 * 0.35 * 0.65 * 14 / 19),
        ("logseries", lambda k: random.logseries(k, 0.5), 1 / math.log(2), 2 / math.log(2) - 1 / math.log(2) ** 2),
        ("zipf", lambda k: random.zipf(k, 6.0), 1.0369277551 / 1.0173430620, 0.025),
        ("dirichlet", lambda k: F.get(random.dirichlet(k, [1.0, 2.0, 3.0]), 1), 1 / 3, (1 / 3) * (2 / 3) / 7),
        ("multinomial", lambda k: F.get(random.multinomial(k, 8, [0.2, 0.5, 0.3]), 1), 4, 2),
        ("multivariate_normal", lambda k: F.get(random.multivariate_normal(k, [1.0, 2.0], [[2.0, 0.5], [0.5, 1.0]]), 1), 2, 1),
        ("standard_exponential", lambda k: random.standard_exponential(k), 1, 1),
        ("random_sample", lambda k: random.random_sample(k), 0.5, 1 / 12),
        ("random_bytes", lambda k: F.ascii(F.substring(F.hex(random.random_bytes(k, 40)), 79, 1)), None, None),
    ],
)
def test_random_moments(spark, name, make, mean, var):
    m, v = _moments(spark, make)
    if mean is not None:
        assert m == pytest.approx(mean, abs=5 * math.sqrt(var / 20_000)) and v == pytest.approx(var, rel=0.15)
    two = spark.range(100).repartition(7).select(make(["id"]).cast("double").alias("r"), "id").orderBy("id").toPandas().r
    assert two.equals(spark.range(100).select(make(["id"]).cast("double").alias("r"), "id").orderBy("id").toPandas().r)


SPECIAL = [
    # values as the usual tables give them
    ("jv", (0.0, 2.5), -0.0483837764681979), ("jv", (3.0, 4.0), 0.4301714738756219), ("iv", (1.0, 2.0), 1.5906368546373290), ("kv", (0.5, 2.0), math.sqrt(math.pi / 4) * math.exp(-2)), ("kn", (0.0, 1.0), 0.4210244382407083),
    ("ive", (0.0, 1.0), 1.2660658777520084 * math.exp(-1)), ("ellipk", (0.5,), 1.8540746773013719), ("ellipe", (0.5,), 1.3506438810476755), ("ellipkm1", (0.5,), 1.8540746773013719), ("gammainc", (2.0, 1.0), 1 - 2 * math.exp(-1)), ("gammainc", (2.0, 9.0), 1 - 10 * math.exp(-9)),
    ("gammaincc", (1.0, 3.0), math.exp(-3)), ("betainc", (2.0, 3.0, 0.4), 0.5248), ("betainc", (2.0, 3.0, 0.9), 0.9963), ("erfinv", (0.5,), 0.4769362762044699), ("erfcinv", (1.5,), -0.4769362762044699), ("erfcx", (1.0,), math.e * math.erfc(1)),
    ("erfcx", (9.0,), 0.0623077240377748), ("dawsn", (1.0,), 0.5380795069127684), ("erfi", (1.0,), 1.6504257587975429), ("polygamma", (1.0, 1.0), math.pi**2 / 6), ("polygamma", (2.0, 1.0), -2.4041138063191886), ("gammasgn", (-0.5,), -1.0),
    ("multigammaln", (3.0, 2.0), 0.5 * math.log(math.pi) + math.lgamma(3) + math.lgamma(2.5)), ("hyp0f1", (1.5, 1.0), math.sinh(2) / 2), ("hyp1f1", (1.0, 2.0, 1.0), math.e - 1), ("hyp2f1", (1.0, 1.0, 2.0, 0.5), 2 * math.log(2)),
]


def test_special_functions(spark):
    from weft.functions import numeric

    got = spark.range(1).select(*[numeric.special(n)(*[F.lit(float(a)) for a in args]).alias(f"r{k}") for k, (n, args, _) in enumerate(SPECIAL)]).first()
    for k, (name, args, want) in enumerate(SPECIAL):
        assert got[k] == pytest.approx(want, rel=1e-7), (name, args)


def test_boosted_trees_learn(spark):
    from weft.operators import learn

    df = spark.range(400).selectExpr("id", "id % 20 as a", "if(id % 3 = 0, null, id % 7) as b").selectExpr("*", "cast(a > 9 as double) as y", "if(a > 9, 5.0, a / 10) as z")
    assert learn.boost_predict(df, learn.boost(df, ["a", "b"], "y", "classification", rounds=5), ["a", "b"]).where("prediction = y").count() == 400
    off = learn.boost_predict(df, learn.boost(df, ["a", "b"], "z", rounds=30, rate=0.3), ["a", "b"]).agg(F.max(F.abs(F.col("prediction") - F.col("z")))).first()[0]
    assert off < 0.1


def test_targets_folds_and_checks(spark):
    from weft.operators import learn

    df = spark.range(200).selectExpr("id", "id % 2 as b", "id % 5 as m", "id / 7 as c", "array(id % 2, 1) as l")
    assert [learn.type_of_target(df, x) for x in "bmcl"] == ["binary", "multiclass", "continuous", "multilabel-indicator"] and learn.is_multilabel(df, "l")
    folds = [r["count"] for r in learn.k_fold(df, ["id"], 4).groupBy("fold").count().collect()]
    assert len(folds) == 4 and sum(folds) == 200 and min(folds) > 25
    assert learn.check_consistent_length(df, df) == 200
    with pytest.raises(ValueError):
        learn.check_consistent_length(df, df.limit(3))
    with pytest.raises(Exception, match="negative"):
        learn.check_non_negative(df.selectExpr("id - 5.0 as x"), ["x"]).collect()
    with pytest.raises(Exception, match="not finite"):
        learn.assert_all_finite(df.selectExpr("double('nan') as x"), ["x"]).collect()
    assert learn.assert_all_finite(df, ["c"]).count() == 200
    blobs = learn.make_classification(spark, 300, 2, 3, 6.0)
    assert blobs.where("(x[0] > 3) = (label = 1)").count() > 290
    rows = np.array([r.x for r in learn.make_low_rank_matrix(spark, 50, 6, 2).collect()])
    assert np.linalg.matrix_rank(rows, tol=1e-8) == 2
    made, s, _ = learn.truncated_svd(spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(rows)], "id bigint, x array<double>"), "id", "x", 6, 2)
    assert np.linalg.norm([r.svd for r in made.collect()], axis=0) == pytest.approx(s, rel=1e-6)


def test_groups_reach_reducers_whole(spark):
    import pandas as pd

    rows = [(None if k % 11 == 0 else k % 4, k) for k in range(3000)]
    df = spark.createDataFrame(rows, "k bigint, v bigint")
    want = {}
    for k, v in rows:
        want[k] = want.get(k, 0) + v
    one = Frame(df).groupby("k", dropna=False).mf.apply_chunk(lambda p: pd.DataFrame({"k": p.k[:1].astype("Int64"), "n": [p.v.sum()]}), "k bigint, n bigint").df.collect()
    assert {r.k: r.n for r in one} == want and len(one) == len(want)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        many = Frame(df).mf.map_reduce(None, lambda b: b.groupby("k", dropna=False, as_index=False).v.sum().astype({"k": "Int64"}).rename(columns={"v": "n"}), ["k"], "k bigint, n bigint", whole_groups=True).df.collect()
        again = Frame(df).mf.map_reduce(None, lambda p: pd.DataFrame({"k": p.k[:1].astype("Int64"), "n": [p.v.sum()]}), ["k"], "k bigint, n bigint", order_cols=["v"]).df.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.k: r.n for r in many} == want == {r.k: r.n for r in again} and len(many) == len(again) == len(want)


def test_orders_are_asked_for(spark):
    df = spark.createDataFrame([(1, 2), (1, 3)], "a int, b int")
    for make in (lambda f: f.drop_duplicates(["a"]), lambda f: f.groupby("a").agg(x=("b", "first")), lambda f: f.groupby("a").agg(x=("b", "idxmax"))):
        with pytest.raises(ValueError, match="order"):
            make(Frame(df))
    assert Frame(df, ["b"]).groupby("a").agg(x=("b", "idxmax")).df.first().x == 3
    least = spark.createDataFrame([(1, -(2**63)), (2, 5)], "i int, v bigint")
    assert Frame(least, ["i"]).agg(x=("v", "idxmax")).df.first().x == 2


def test_rows_one_by_one_and_errors(spark, tmp_path):
    import base64

    from weft.operators import models

    f = made(spark, [(2, "b"), (1, "a")], "k int, x string", ["k"])
    assert list(f.iterrows()) == [((1,), {"k": 1, "x": "a"}), ((2,), {"k": 2, "x": "b"})] and list(f.itertuples()) == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError, match="repeat"):
        made(spark, [(1,), (1,)], "k int").merge(f, on="k", validate="1:1")
    nested = spark.createDataFrame([({"a": 1}, [1, 2])], "m map<string,int>, l array<int>")
    with pytest.raises(Exception, match="no key"):
        Frame(nested).df.select(Frame(nested)["m"].dict.at("z").column).collect()
    with pytest.raises(Exception, match="no place"):
        Frame(nested).df.select(Frame(nested)["l"].list.at(2).column).collect()
    url = "data:;base64," + base64.b64encode(b"bytes").decode()
    got = spark.createDataFrame([(url,), (None,), ("data:broken",)], "u string").select(media.url_download(F.col("u"), "coerce").alias("b")).collect()
    assert [r.b and bytes(r.b) for r in got] == [b"bytes", None, None]
    sound = [0] * 800 + [1000, -1000] * 400 + [0] * 800
    assert spark.createDataFrame([(sound,)], "s array<int>").select(media.voice_spans(F.col("s"), 8000)).first()[0] == [[800, 1600]]
    (tmp_path / "m.json").write_text('{"one": {"dim": 3}}')
    kept = models.Registry()
    kept.register_folder(str(tmp_path), lambda settings: models.EchoModel(**settings))
    assert kept.get("one").dim == 3


def test_many_queries_meet_rows_in_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(k, [float(k % 7), float(k % 3)]) for k in range(60)], "id int, v array<double>")
    want = sorted(map(tuple, learn.pairwise_distances(rows, rows, "id", "v").collect()))
    monkeypatch.setattr(learn, "BLOCK", 9)
    assert sorted(map(tuple, learn.pairwise_distances(rows, rows, "id", "v").collect())) == want and len(want) == 3600


def test_similarities_of_all_pairs_without_copies_of_vectors(spark):
    from weft.plans import registry

    folder = "/root/testdata/sf0.01"
    ids = [r.vec_id for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id").collect()]
    made = registry.queries()["learn_pairwise_cosine_similarity"](spark, folder)
    assert {(r["query"], r["key"]) for r in made.collect()} == {(x, y) for x in ids for y in ids}
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.partition("CartesianProduct")[0] and "explode" not in plan


def test_distances_of_blocks_with_missing_numbers(spark, monkeypatch):
    monkeypatch.setattr(learn, "BLOCK", 3)
    monkeypatch.setattr(learn, "TILE", (2, 2))
    rows = spark.createDataFrame([(k, None if k % 7 == 3 else [float(k), None if k % 5 == 4 else 1.0][: 1 + (k % 4 > 0)]) for k in range(20)], "id int, v array<double>").coalesce(1)
    vectors = {r.id: r.v for r in rows.collect()}
    fit = lambda a, b: a and b and len(a) == len(b) and None not in a + b
    want = {(x, y): sum(abs(p - q) for p, q in zip(a, b)) if fit(a, b) else None for x, a in vectors.items() for y, b in vectors.items()}
    assert {(r["query"], r["key"]): r.distance for r in learn.pairwise_distances(rows, rows, "id", "v", "manhattan").collect()} == want
    near = {r["query"]: r["key"] for r in learn.pairwise_topk(rows, rows, "id", "v", 1, "manhattan").collect()}
    assert near == {x: min((d is None, d or 0.0, y) for (w, y), d in want.items() if w == x != y)[2] for x in vectors}


def test_distances_come_from_blocks_and_missing_vectors_are_last(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [1.0, 2.0, 3.0]), (4, [0.0, 0.0]), (5, [math.nan, 1.0]), (7, [1.0, 2.0])], "id int, v array<double>")
    got = learn.pairwise_topk(rows.where("id = 0"), rows, "id", "v", 6)
    assert [r.key for r in got.orderBy("rank").collect()] == [7, 4, 5, 1, 2, 3]
    made = learn.pairwise_distances(rows.where("id = 4"), rows, "id", "v", "cosine")
    assert "MapInArrow" in made._jdf.queryExecution().toString()
    assert all(r.distance is None or math.isnan(r.distance) for r in made.collect())


def test_what_comes_after_is_gathered_from_the_end(spark):
    rows = [(k, None if k % 4 == 0 or k > 17 else k, k % 2) for k in range(20)]
    f = made(spark, rows, "k int, x int, g int", ["k"])
    want = [next((x for j, x, _ in rows if j >= k and x is not None), None) for k in range(20)]
    held = [next((x for j, x, h in rows if j >= k and h == g and x is not None), None) for k, _, g in rows]
    for got, r in ((f.filled("x", "r", back=True), want), (f.assign(r=f["x"].bfill().column), want), (f.groupby("g").bfill("x", "r"), held)):
        assert "unboundedfollowing" not in got.df._jdf.queryExecution().toString().lower()
        assert [a.r for a in got.df.orderBy("k").collect()] == r
    for how, r in (("sum", [sum(x or 0 for _, x, _ in rows[k:]) if k < 18 else None for k in range(20)]), ("last", [17 if k < 18 else None for k in range(20)]), ("count", [sum(x is not None for _, x, _ in rows[k:]) for k in range(20)])):
        assert [a.r for a in ranges.running(f.df, ["k"], F.col("x"), how, "r", back=True).orderBy("k").collect()] == r


def test_mappers_get_batches_of_bounded_text(monkeypatch):
    b = pd.DataFrame({"k": range(6), "t": ["aaaa", "bb", None, "c" * 30, "dd", "e"]})
    monkeypatch.setattr(dataflow, "TEXT", 6)
    seen = [p.k.tolist() for p in dataflow._stream(lambda p: p, iter([b, b.iloc[:0], b[["k"]]]), None)]
    assert seen == [[0, 1, 2], [3], [4, 5], [0, 1, 2, 3, 4, 5]]
    assert [p.k.tolist() for p in dataflow._stream(lambda p: p, iter([b]), 4)] == [[0, 1, 2, 3], [4, 5]]


def test_fft_of_whole_lines(spark):
    from weft.operators import tensor as X

    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(5, 7)), rng.normal(size=(5, 7))
    cells = lambda m: X.Tensor(spark.createDataFrame([(r, c, float(m[r, c])) for r in range(5) for c in range(7)], "i0 bigint, i1 int, v double"), 2)
    dense = lambda t: t.df.groupBy("i0").pivot("i1").agg(F.first("v")).orderBy("i0").drop("i0").toPandas().to_numpy()
    re, im = X.fft(cells(x), 1, 7)
    assert np.allclose(dense(re) + 1j * dense(im), np.fft.fft(x))
    back = X.ifft(re, im, 1, 7)[0]
    plan = back.df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    assert np.allclose(dense(back), x)
    re, im = X.fft(cells(x), 0, 5, imag=cells(y))
    assert np.allclose(dense(re) + 1j * dense(im), np.fft.fft(x + 1j * y, axis=0))
    assert np.allclose(dense(X.ifft(im, re, 0, 5)[0]), np.fft.ifft(np.fft.fft(x + 1j * y, axis=0).imag + 1j * np.fft.fft(x + 1j * y, axis=0).real, axis=0).real)
    # repeated, missing, empty and endless cells
    odd = X.Tensor(spark.createDataFrame([(0, 0, 1.0), (0, 4, 2.0), (0, None, 9.0), (0, 1, None), (1, 2, None), (2, 0, float("inf"))], "i0 int, i1 int, v double"), 2)
    got = {(r.i0, r.i1): r.v for r in X.fft(odd, 1, 4)[0].df.collect()}
    assert got == {(0, k): 3.0 for k in range(4)} | {(1, k): None for k in range(4)} | {(2, k): float("inf") for k in range(4)}
