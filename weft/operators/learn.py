"""Learning operators: metrics, distances, scaling, clustering, components, as Spark plans."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..session import cut
from .join import meet
from .ranges import near, row_number, running

#: Queries of a block at most, and rows of one that meets all of them; of four as many rows the nearest are chosen.
BLOCK = 256
#: Queries and rows whose distances a task makes at once.
TILE = 64, 1_024


# ---- metrics of two columns, true and predicted
def accuracy_score(df: DataFrame, true: str, pred: str) -> DataFrame:
    return df.agg(F.avg((F.col(true) == F.col(pred)).cast("double")).alias("accuracy"))


def confusion(df: DataFrame, true: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(true).alias("true"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def precision_recall_fscore(df: DataFrame, true: str, pred: str, beta: float = 1.0) -> DataFrame:
    """One row for each label; what has no rows to divide by is 0."""
    c = confusion(df, true, pred)
    t = c.groupBy(F.col("true").alias("label")).agg(F.sum("n").alias("support"))
    p = c.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("predicted"))
    hit = c.where(F.col("true") == F.col("pred")).select(F.col("true").alias("label"), F.col("n").alias("hit"))
    j = t.join(p, "label", "full").join(hit, "label", "left").fillna(0, ["support", "predicted", "hit"])
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    precision, recall, b2 = ratio(F.col("hit"), F.col("predicted")), ratio(F.col("hit"), F.col("support")), beta * beta
    return j.select("label", precision.alias("precision"), recall.alias("recall"), ratio((1 + b2) * precision * recall, b2 * precision + recall).alias("fscore"), "support")


def log_loss(df: DataFrame, true: str, prob: str, eps: float = 1e-15) -> DataFrame:
    p = F.least(F.greatest(F.col(prob), F.lit(eps)), F.lit(1 - eps))
    return df.agg(F.avg(-F.when(F.col(true) == 1, F.log(p)).otherwise(F.log(1 - p))).alias("log_loss"))


def roc_curve(df: DataFrame, true: str, score: str) -> DataFrame:
    """(threshold, fpr, tpr), one row for each distinct score.  Counts by score come first; sums run over those."""
    by = df.groupBy(F.col(score).alias("threshold")).agg(F.sum((F.col(true) == 1).cast("bigint")).alias("tp"), F.sum((F.col(true) != 1).cast("bigint")).alias("fp"))
    by = running(by, ["threshold"], F.col("tp"), "sum", "up_tp", back=True)
    by = running(by, ["threshold"], F.col("fp"), "sum", "up_fp", back=True)
    whole = by.agg(F.sum("tp").alias("all_tp"), F.sum("fp").alias("all_fp"))
    return by.join(F.broadcast(whole)).select("threshold", (F.col("up_fp") / F.col("all_fp")).alias("fpr"), (F.col("up_tp") / F.col("all_tp")).alias("tpr"))


def auc(curve: DataFrame, x: str = "fpr", y: str = "tpr", start: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    made = near(curve.select(x, y), [x, y], 1, 0, {"__x": lambda w: F.lag(x).over(w), "__y": lambda w: F.lag(y).over(w)})
    dx = F.col(x) - F.coalesce("__x", F.lit(start[0]))
    return made.select((dx * (F.col(y) + F.coalesce("__y", F.lit(start[1]))) / 2).alias("a")).agg(F.sum("a").alias("auc"))


def roc_auc_score(df: DataFrame, true: str, score: str) -> DataFrame:
    return auc(roc_curve(df, true, score))


def r2_score(df: DataFrame, true: str, pred: str) -> DataFrame:
    t, p = F.col(true), F.col(pred)
    return df.agg((1 - F.sum((t - p) * (t - p)) / (F.var_pop(t) * F.count(t))).alias("r2"))


# ---- rows of numbers
def _zip(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, x: s + x)


def _dot(a: Column, b: Column) -> Column:
    return _zip(a, b, lambda x, y: x.cast("double") * y.cast("double"))


def distance(a: Column, b: Column, metric: str = "euclidean") -> Column:
    if metric == "cosine":
        return 1 - _dot(a, b) / F.sqrt(_dot(a, a) * _dot(b, b))
    if metric == "cosine_similarity":
        return _dot(a, b) / F.sqrt(_dot(a, a) * _dot(b, b))
    if metric == "manhattan":
        return _zip(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    squared = _zip(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    if metric == "sqeuclidean":
        return squared
    if metric == "rbf":
        return F.exp(-squared / F.size(a))
    return F.sqrt(squared)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return 2 * F.asin(F.sqrt(F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), 2)))


class _Vectors:
    """Keys and vectors of one Arrow batch or more; ``whole`` tells vectors that are not null and hold no null."""

    def __init__(self, keys: pa.Array, vectors: pa.Array) -> None:
        self.keys = keys
        holes = np.zeros(len(vectors), dtype=np.int64)
        if vectors.flatten().null_count:
            holes = np.bincount(pc.list_parent_indices(vectors).to_numpy()[~vectors.flatten().is_valid().to_numpy(zero_copy_only=False)], minlength=len(vectors))
        self.whole = vectors.is_valid().to_numpy(zero_copy_only=False) & (holes == 0)
        self.sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy().astype(np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.values = pc.fill_null(vectors.flatten(), 0).to_numpy().astype(np.float64)

    def __len__(self) -> int:
        return len(self.keys)

    def of(self, size: int, rows: np.ndarray) -> np.ndarray:
        """Vectors of ``size`` numbers, a column for each of ``rows``."""
        return np.ascontiguousarray(self.values[self.first[rows][None, :] + np.arange(size)[:, None]])


def _summed(a: np.ndarray, b: np.ndarray, f) -> np.ndarray:
    """Sums of ``f(x, y, out)`` place by place, in the order of the places."""
    total, part = np.zeros((a.shape[1], b.shape[1])), np.empty((a.shape[1], b.shape[1]))
    for x, y in zip(a, b):
        total += f(x[:, None], y[None, :], part)
    return total


def _squared(x, y, out):
    np.subtract(x, y, out=out)
    return np.multiply(out, out, out=out)


def _apart(x, y, out):
    np.subtract(x, y, out=out)
    return np.abs(out, out=out)


def _measured(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    with np.errstate(all="ignore"):
        if metric in ("cosine", "cosine_similarity"):
            own = [np.zeros(v.shape[1]) for v in (a, b)]
            for total, v in zip(own, (a, b)):
                for x in v:
                    total += x * x
            alike = _summed(a, b, np.multiply) / np.sqrt(own[0][:, None] * own[1][None, :])
            return 1 - alike if metric == "cosine" else alike
        if metric == "manhattan":
            return _summed(a, b, _apart)
        squared = _summed(a, b, _squared)
        if metric == "rbf":
            return np.exp(-squared / len(a))
        return squared if metric == "sqeuclidean" else np.sqrt(squared)


def _distances(q: _Vectors, r: _Vectors, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """(distances, whether known) of all queries and rows; unknown where a vector is missing or sizes differ."""
    out, known = np.zeros((len(q), len(r))), np.zeros((len(q), len(r)), dtype=bool)
    for size in np.intersect1d(q.sizes[q.whole], r.sizes[r.whole]).tolist():
        i, j = (np.flatnonzero(v.whole & (v.sizes == size)) for v in (q, r))
        if len(i) == len(q) and len(j) == len(r):
            return _measured(q.of(size, i), r.of(size, j), metric), ~known
        out[np.ix_(i, j)] = _measured(q.of(size, i), r.of(size, j), metric)
        known[np.ix_(i, j)] = True
    return out, known


def _nearest(d: np.ndarray, known: np.ndarray, differ: np.ndarray, places: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (query, row) of each query's ``k`` least distances, ties by the rows' ``places``; NaN, then unknown, are last."""
    kind = np.where(known, np.isnan(d), 2)
    at = [np.zeros(0, np.int64)] * 2
    for i in range(len(d)):
        some = np.flatnonzero(differ[i])
        if len(some) > k:
            sound = some[kind[i, some] == 0]
            if len(sound) >= k:
                some = sound[d[i, sound] <= np.partition(d[i, sound], k - 1)[k - 1]]
            some = some[np.lexsort((places[some], np.where(kind[i, some] == 0, d[i, some], 0), kind[i, some]))[:k]]
        at = [np.append(at[0], np.full(len(some), i)), np.append(at[1], some)]
    return at[0], at[1]


def _packed(df: DataFrame, key: str, vector: str, names: tuple[str, str], size: int) -> DataFrame:
    """Keys and vectors of at most ``size`` rows in each row, as arrays of ``names``."""
    made = df.select(F.col(key).alias(names[0]), F.col(vector).alias(names[1]))

    def run(batches):
        for batch in batches:
            for x in range(0, len(batch), size):
                part = batch.slice(x, size)
                yield pa.record_batch([pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), c) for c in part.columns], names=list(names))

    return made.mapInArrow(run, StructType([StructField(f.name, ArrayType(f.dataType)) for f in made.schema.fields]))


def _meetings(queries: DataFrame, rows: DataFrame, key: str, vector: str, metric: str, k: int | None = None) -> DataFrame:
    """(query, key, distance): blocks of queries meet blocks of rows, each block written once; distances are numpy's.

    With ``k``, only what may be among a query's ``k`` nearest other rows leaves a tile.
    """
    kinds = [df.schema[key].dataType for df in (queries, rows)]
    met = meet(_packed(queries, key, vector, ("query", "a"), BLOCK), _packed(rows, key, vector, ("key", "b"), 4 * BLOCK if k else BLOCK), F.lit(True))

    def run(batches):
        for batch in batches:
            for query, a, theirs, b in zip(*(batch.column(c) for c in ("query", "a", "key", "b"))):
                for y in range(0, len(b), TILE[1]):
                    right = _Vectors(theirs.values.slice(y, TILE[1]), b.values.slice(y, TILE[1]))
                    for x in range(0, len(a), TILE[0]):
                        yield made(_Vectors(query.values.slice(x, TILE[0]), a.values.slice(x, TILE[0])), right)

    def made(mine: _Vectors, theirs: _Vectors):
        d, known = _distances(mine, theirs, metric)
        if k is None:
            i, j = np.repeat(np.arange(len(mine)), len(theirs)), np.tile(np.arange(len(theirs)), len(mine))
        else:
            order = pc.sort_indices(theirs.keys).to_numpy()
            places = np.empty(len(order), np.int64)
            places[order] = np.arange(len(order))
            whole = pa.concat_arrays([mine.keys, theirs.keys.cast(mine.keys.type)]).dictionary_encode().indices
            codes = pc.fill_null(whole, -1).to_numpy()
            a, b = codes[: len(mine)], codes[len(mine) :]
            i, j = _nearest(d, known, (a[:, None] != b[None, :]) & (a >= 0)[:, None] & (b >= 0)[None, :], places, k)
        sure = known[i, j]
        return pa.record_batch([mine.keys.take(pa.array(i)), theirs.keys.take(pa.array(j)), pa.array(d[i, j], mask=None if sure.all() else ~sure)], names=["query", "key", "distance"])

    return met.mapInArrow(run, StructType([StructField("query", kinds[0]), StructField("key", kinds[1]), StructField("distance", DoubleType())]))


def pairwise_distances(queries: DataFrame, rows: DataFrame, key: str, vector: str, metric: str = "euclidean") -> DataFrame:
    """(query, key, distance) of all ``queries`` against all ``rows``; see ``_meetings``."""
    return _meetings(queries, rows, key, vector, metric)


def pairwise_topk(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, metric: str = "euclidean") -> DataFrame:
    """The ``k`` nearest rows of each query, itself left out; a batch hands on its own nearest only."""
    d = _meetings(queries, rows, key, vector, metric, k)
    w = Window.partitionBy("query").orderBy(F.col("distance").asc_nulls_last(), "key")
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def normalize(df: DataFrame, vector: str, norm: str = "l2") -> DataFrame:
    v = F.col(vector)
    size = {"l1": F.aggregate(v, F.lit(0.0), lambda s, x: s + F.abs(x.cast("double"))), "l2": F.sqrt(_dot(v, v)), "max": F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))}[norm]
    return df.withColumn(vector, F.transform(v, lambda x: F.coalesce(F.try_divide(x.cast("double"), size), F.lit(0.0))))


def standard_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    stats = df.agg(*[x for c in columns for x in (F.avg(c).alias(f"__m_{c}"), F.stddev_pop(c).alias(f"__s_{c}"))])
    return df.join(F.broadcast(stats)).withColumns({c: (F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") == 0, 1.0).otherwise(F.col(f"__s_{c}")) for c in columns}).drop(*stats.columns)


def minmax_scale(df: DataFrame, columns: list[str], low: float = 0.0, high: float = 1.0) -> DataFrame:
    stats = df.agg(*[x for c in columns for x in (F.min(c).alias(f"__a_{c}"), F.max(c).alias(f"__b_{c}"))])
    return df.join(F.broadcast(stats)).withColumns({c: F.lit(low) + (F.col(c) - F.col(f"__a_{c}")) * (high - low) / F.when(F.col(f"__b_{c}") == F.col(f"__a_{c}"), 1.0).otherwise(F.col(f"__b_{c}") - F.col(f"__a_{c}")) for c in columns}).drop(*stats.columns)


def label_encode(df: DataFrame, column: str, to: str = "code") -> DataFrame:
    codes = df.select(column).where(F.col(column).isNotNull()).distinct()
    codes = row_number(codes, [column], to).withColumn(to, F.col(to).cast("int"))
    return df.join(codes, column, "left")


def label_binarize(df: DataFrame, column: str, classes: list) -> DataFrame:
    return df.withColumn("onehot", F.array(*[F.coalesce((F.col(column) == F.lit(c)).cast("int"), F.lit(0)) for c in classes]))


def train_test_split(df: DataFrame, keys: list[str], test_size: float = 0.25, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """By a hash of the keys: the same rows whatever the partitions."""
    share = F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1_000_000)) < int(test_size * 1_000_000)
    return df.where(~share), df.where(share)


def shuffle(df: DataFrame, keys: list[str], seed: int = 0) -> DataFrame:
    return df.orderBy(F.xxhash64(*keys, F.lit(seed)), *keys)


def k_means(df: DataFrame, vector: str, k: int, max_iter: int = 20, seed: int = 1):
    """(rows with ``cluster``, fitted model), by MLlib's k-means||."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    featured = df.withColumn("__v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    model = KMeans(k=k, maxIter=max_iter, seed=seed, featuresCol="__v", predictionCol="cluster").fit(featured)
    return model.transform(featured).drop("__v"), model


def linear_fit(df: DataFrame, features: list[str], target: str) -> np.ndarray:
    """Least squares with an intercept last, from one pass of sums of products."""
    cols = [F.col(f).cast("double") for f in features] + [F.lit(1.0)]
    y = F.col(target).cast("double")
    n = len(cols)
    row = df.agg(*[F.sum(cols[i] * cols[j]) for i in range(n) for j in range(n)], *[F.sum(c * y) for c in cols]).first()
    return np.linalg.lstsq(np.array(row[: n * n]).reshape(n, n), np.array(row[n * n :]), rcond=None)[0]


def linear_predict(df: DataFrame, features: list[str], weights: np.ndarray, to: str = "prediction") -> DataFrame:
    out = F.lit(float(weights[-1]))
    for f, w in zip(features, weights):
        out = out + F.col(f) * F.lit(float(w))
    return df.withColumn(to, out)


def logistic_fit(df: DataFrame, features: list[str], target: str, rounds: int = 8) -> np.ndarray:
    """Newton's steps, each one pass of sums; intercept last."""
    cols = [F.col(f).cast("double") for f in features] + [F.lit(1.0)]
    w = np.zeros(len(cols))
    for _ in range(rounds):
        z = F.lit(0.0)
        for c, v in zip(cols, w):
            z = z + c * F.lit(float(v))
        p = 1 / (1 + F.exp(-z))
        n = len(cols)
        row = df.agg(*[F.sum(cols[i] * cols[j] * p * (1 - p)) for i in range(n) for j in range(n)], *[F.sum(c * (F.col(target) - p)) for c in cols]).first()
        step = np.linalg.lstsq(np.array(row[: n * n]).reshape(n, n) + 1e-9 * np.eye(n), np.array(row[n * n :]), rcond=None)[0]
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_iter: int = 6) -> tuple[DataFrame, bool]:
    """((id, component) of the vertices that aren't their own root, whether it ended by itself).

    Labels fall to the smallest neighbour's and then to their label's label, so the
    reach doubles with each round.
    """
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).union(edges.select(F.col(b), F.col(a))).where("x is not null and y is not null").distinct()
    both = cut(both)
    labels = cut(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("c")))
    done = False
    for _ in range(max_iter):
        near = both.join(labels.select(F.col("x").alias("y"), "c"), "y").groupBy("x").agg(F.min("c").alias("n"))
        low = labels.join(near, "x").select("x", "c", F.least("c", "n").alias("n"))
        jump = low.join(labels.select(F.col("x").alias("n"), F.col("c").alias("j")), "n", "left")
        new = cut(jump.select("x", "c", F.least("n", F.coalesce("j", "n")).alias("n")))
        if new.where("c <> n").isEmpty():
            done = True
            break
        labels = new.select("x", F.col("n").alias("c"))
    return labels.where("x <> c").select(F.col("x").alias("id"), F.col("c").alias("component")), done


def make_blobs(spark, n: int, centers: list[list[float]], std: float = 1.0, seed: int = 0) -> DataFrame:
    df = spark.range(n).withColumn("label", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(len(centers))).cast("int"))
    centre = F.element_at(F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centers]), F.col("label") + 1)
    noise = F.array(*[F.randn(seed + k) * std for k in range(len(centers[0]))])
    return df.select("id", "label", F.zip_with(centre, noise, lambda x, y: x + y).alias("x"))


def make_regression(spark, n: int, weights: list[float], noise: float = 0.0, seed: int = 0) -> DataFrame:
    df = spark.range(n).select("id", *[F.randn(seed + k).alias(f"x{k}") for k in range(len(weights))])
    y = F.randn(seed + 99) * noise
    for k, w in enumerate(weights):
        y = y + F.col(f"x{k}") * w
    return df.withColumn("y", y)




# ---- scores of predicted labels
_AVERAGES = ("macro", "micro", "weighted", "binary")


def multilabel_confusion(df: DataFrame, true: str, pred: str) -> DataFrame:
    """(label, tn, fp, fn, tp), each label against all others."""
    c = confusion(df, true, pred)
    t = c.groupBy(F.col("true").alias("label")).agg(F.sum("n").alias("support"))
    p = c.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("predicted"))
    hit = c.where(F.col("true") == F.col("pred")).select(F.col("true").alias("label"), F.col("n").alias("tp"))
    total = c.agg(F.sum("n").alias("total"))
    j = t.join(p, "label", "full").join(hit, "label", "left").fillna(0, ["support", "predicted", "tp"]).join(F.broadcast(total))
    fp, fn = F.col("predicted") - F.col("tp"), F.col("support") - F.col("tp")
    return j.select("label", (F.col("total") - F.col("tp") - fp - fn).alias("tn"), fp.alias("fp"), fn.alias("fn"), "tp")


def _score(df: DataFrame, true: str, pred: str, name: str, average: str, positive, beta: float) -> DataFrame:
    if average not in _AVERAGES:
        raise ValueError(f"average must be one of {_AVERAGES}")
    each = multilabel_confusion(df, true, pred)
    if average == "binary":
        each = each.where(F.col("label") == F.lit(positive))
    if average == "micro":
        each = each.agg(*[F.sum(c).alias(c) for c in ("fp", "fn", "tp")])
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn, b2 = F.col("tp"), F.col("fp"), F.col("fn"), beta * beta
    made = {"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "fscore": ratio((1 + b2) * tp, (1 + b2) * tp + b2 * fn + fp)}[name]
    if average == "weighted":
        return each.agg(ratio(F.sum(made * (tp + fn)), F.sum(tp + fn)).alias(name))
    return each.agg(F.coalesce(F.avg(made), F.lit(0.0)).alias(name))


def precision_score(df: DataFrame, true: str, pred: str, average: str = "binary", positive=1) -> DataFrame: return _score(df, true, pred, "precision", average, positive, 1.0)
def recall_score(df: DataFrame, true: str, pred: str, average: str = "binary", positive=1) -> DataFrame: return _score(df, true, pred, "recall", average, positive, 1.0)
def fbeta_score(df: DataFrame, true: str, pred: str, beta: float, average: str = "binary", positive=1) -> DataFrame: return _score(df, true, pred, "fscore", average, positive, beta)
def f1_score(df: DataFrame, true: str, pred: str, average: str = "binary", positive=1) -> DataFrame: return fbeta_score(df, true, pred, 1.0, average, positive)


#: Scores by name, each a function of (frame, true column, predicted column).
SCORERS = {"accuracy": accuracy_score, "r2": r2_score, "roc_auc": roc_auc_score, "neg_log_loss": lambda d, t, p: log_loss(d, t, p).select((-F.col("log_loss")).alias("neg_log_loss")), "precision": precision_score, "recall": recall_score, "f1": f1_score} | {f"{n}_{a}": (lambda d, t, p, f=f, a=a: f(d, t, p, a)) for n, f in (("precision", precision_score), ("recall", recall_score), ("f1", f1_score)) for a in ("macro", "micro", "weighted")}


def get_scorer(name: str): return SCORERS[name]


# ---- folds, targets, checks
def k_fold(df: DataFrame, keys: list[str], n_splits: int = 5, seed: int = 0, to: str = "fold") -> DataFrame:
    """Rows with the number of the fold that tests them, by a hash of their keys."""
    return df.withColumn(to, F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(n_splits)).cast("int"))


def unique_labels(*columns: DataFrame) -> DataFrame:
    """Distinct labels of frames of one column each."""
    out = None
    for c in columns:
        c = c.toDF("label")
        out = c if out is None else out.union(c)
    return out.where("label is not null").distinct()


def type_of_target(df: DataFrame, column: str) -> str:
    """binary, multiclass, continuous, multilabel-indicator or continuous-multioutput."""
    kind = df.schema[column].dataType.simpleString()
    if kind.startswith("array"):
        fractions = df.where(F.exists(column, lambda x: x.cast("double") != F.floor(x.cast("double")))).limit(1)
        if not fractions.isEmpty():
            return "continuous-multioutput"
        return "multilabel-indicator" if df.where(F.exists(column, lambda x: ~x.cast("double").isin(0.0, 1.0))).limit(1).isEmpty() else "multiclass-multioutput"
    if kind in ("float", "double") and not df.where(F.col(column) != F.floor(column)).limit(1).isEmpty():
        return "continuous"
    return "binary" if df.select(column).distinct().limit(3).count() <= 2 else "multiclass"


def is_multilabel(df: DataFrame, column: str) -> bool: return type_of_target(df, column) == "multilabel-indicator"
def assert_all_finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows as they are; a NaN or an infinite value stops the job that meets it."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))
    return df.withColumns({c: F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit("not finite")).cast("double")).otherwise(F.col(c)) for c in columns})


def check_non_negative(df: DataFrame, columns: list[str]) -> DataFrame:
    bad = F.lit(False)
    for c in columns:
        bad = bad | (F.col(c) < 0)
    return df.withColumns({c: F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit("negative")).cast("double")).otherwise(F.col(c)) for c in columns})


def check_consistent_length(*frames: DataFrame) -> int:
    sizes = {f.count() for f in frames}
    if len(sizes) > 1:
        raise ValueError(f"frames of different lengths: {sorted(sizes)}")
    return sizes.pop() if sizes else 0


# ---- preprocessing and data
def one_hot(df: DataFrame, categories: dict[str, list], to: str = "onehot") -> DataFrame:
    """One array for all columns: a place for each category of each; unknown values set none."""
    flags = [F.coalesce((F.col(c) == F.lit(v)).cast("double"), F.lit(0.0)) for c, values in categories.items() for v in values]
    return df.withColumn(to, F.array(*flags))


def categories(df: DataFrame, columns: list[str], most: int = 10_000) -> dict[str, list]:
    """Distinct values of each column in order; more than ``most`` is an error."""
    out = {}
    for c in columns:
        got = sorted(r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().limit(most + 1).collect())
        if len(got) > most:
            raise ValueError(f"{c} has more than {most} categories")
        out[c] = got
    return out


def scale(df: DataFrame, columns: list[str], with_mean: bool = True, with_std: bool = True) -> DataFrame:
    stats = df.agg(*[x for c in columns for x in (F.avg(c).alias(f"__m_{c}"), F.stddev_pop(c).alias(f"__s_{c}"))])
    mean = lambda c: F.col(f"__m_{c}") if with_mean else F.lit(0.0)
    std = lambda c: F.when(F.col(f"__s_{c}") == 0, 1.0).otherwise(F.col(f"__s_{c}")) if with_std else F.lit(1.0)
    return df.join(F.broadcast(stats)).withColumns({c: (F.col(c) - mean(c)) / std(c) for c in columns}).drop(*stats.columns)


def row_norms(df: DataFrame, vector: str, squared: bool = False, to: str = "norm") -> DataFrame:
    d = _dot(F.col(vector), F.col(vector))
    return df.withColumn(to, d if squared else F.sqrt(d))


def truncated_svd(df: DataFrame, key: str, vector: str, d: int, k: int, to: str = "svd") -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(rows with their ``k`` components, singular values, components)."""
    from .linalg import svd

    made, s, v = svd(df, key, vector, d, k, to)
    return made.withColumn(to, F.zip_with(to, F.array(*[F.lit(float(x)) for x in s]), lambda x, y: x * y)), s, v


def make_classification(spark, n: int, classes: int = 2, features: int = 4, apart: float = 2.0, seed: int = 0) -> DataFrame:
    """(id, label, x): normal clouds around the corners of a cube of side ``apart``."""
    df = spark.range(n).withColumn("label", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(classes)).cast("int"))
    corner = [F.when(F.col("label").bitwiseAND(1 << k) != 0, apart).otherwise(0.0) for k in range(features)]
    return df.select("id", "label", F.array(*[c + F.randn(seed + k) for k, c in enumerate(corner)]).alias("x"))


def make_low_rank_matrix(spark, n: int, features: int, rank: int, seed: int = 0) -> DataFrame:
    """(id, x): rows of a matrix of ``rank`` directions."""
    v = np.linalg.qr(np.random.default_rng(seed).normal(size=(features, rank)))[0]
    df = spark.range(n).select("id", *[F.randn(seed + k).alias(f"u{k}") for k in range(rank)])
    row = []
    for j in range(features):
        out = F.lit(0.0)
        for k in range(rank):
            out = out + F.col(f"u{k}") * F.lit(float(v[j, k]))
        row.append(out)
    return df.select("id", F.array(*row).alias("x"))


# ---- boosted trees, grown by MLlib over distributed histograms
def boost(df: DataFrame, features: list[str], target: str, task: str = "regression", rounds: int = 20, depth: int = 5, rate: float = 0.1, seed: int = 0):
    """A fitted model of gradient-boosted trees; missing features are -1e308, below every value."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.regression import GBTRegressor

    kind = GBTClassifier if task == "classification" else GBTRegressor
    ready = _assembled(df, features).withColumn("__y", F.col(target).cast("double"))
    return kind(featuresCol="__x", labelCol="__y", maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed).fit(ready)


def _assembled(df: DataFrame, features: list[str]) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("__x", array_to_vector(F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(-1e308)) for f in features])))


def boost_predict(df: DataFrame, model, features: list[str], to: str = "prediction") -> DataFrame:
    made = model.transform(_assembled(df, features))
    return made.withColumn(to, F.col("prediction")).select(*df.columns, to)
